"""Exact Euclidean distances on pixel tables, in two separable passes."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane.operators.scan import CHUNK, running, with_stretch
from filigrane.session import checkpointed


def distance_transform(px: DataFrame, on: str) -> DataFrame:
    """The pixels where `on` holds, with d2: the squared distance to the nearest pixel of the image where it does not (null in
    an image that is all on). px: image_id, y, x from 0, every pixel of the image a row.

    The first pass finds the nearest such pixel in the row, g2. In the second one a pixel at y needs the rows q of its own column up to
    the next ones that are off: the least g2(q) + (y - q)^2, within the distance that its own row and these ends already give. So a task holds one
    stretch of a column inside the mask at a time, and a pixel costs its own distance, not the image."""
    d = px.withColumn("_on", F.expr(on)).withColumn("_ck", F.expr(f"x div {CHUNK}"))
    d = running(d, ["image_id", "y"], ["x"], "_ck", {"_p": ("max", "case when not _on then x end"), "_n": ("min", "case when not _on then x end", "back")})
    d = checkpointed(d.withColumn("g2", F.expr("power(least(x - _p, _n - x), 2)")).drop("_p", "_n", "_ck"))
    d = with_stretch(d, ["image_id", "x"], "_on", pos="y")
    d = running(d.withColumn("_ck", F.expr(f"y div {CHUNK}")), ["image_id", "x"], ["y"], "_ck", {"_e": ("min", "case when not _on then y end", "back")}, cut=True)
    col = d.where("_on").groupBy("image_id", "x", "_gap").agg(
        F.array_sort(F.collect_list(F.struct("y", "g2"))).alias("col"), F.min("y").alias("y0"), F.first("_e").alias("_e"))
    ends = "least(case when _gap >= 0 then power(p.y - _gap, 2) end, case when _e is not null then power(_e - p.y, 2) end)"
    reach = f"cast(floor(sqrt(coalesce(least({ends}, p.g2), power(size(col), 2)))) as int)"
    low = f"greatest(cast(p.y - y0 as int) + 1 - {reach}, 1)"
    near = f"slice(col, {low}, cast(p.y - y0 as int) + 2 + {reach} - {low})"
    one = f"least({ends}, array_min(transform({near}, q -> q.g2 + power(p.y - q.y, 2))))"
    out = col.select("image_id", "x", F.explode(F.expr(f"transform(col, p -> struct(p.y as y, {one} as d2))")).alias("p"))
    return out.select("image_id", "p.y", "x", "p.d2")
