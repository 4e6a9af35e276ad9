"""Tables that grow with the input are joined by shuffles: the driver holds no copy of them."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from filigrane.operators import relate as J
from filigrane.operators import runs as R
from filigrane.operators.scan import running
from filigrane.session import checkpointed


def broadcast_keys(df) -> str:
    """The keys of all broadcast joins of the plan that would run."""
    return " ".join(re.findall(r"BroadcastHashJoin \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString()))


def stored_samples(spark, edges=4, n=60):
    d = spark.range(edges * n).selectExpr("0L as image_id", f"id div {n} as vid", f"id % {n} as i")
    return checkpointed(d.select("*", *[F.expr(f"cast({e} as double) as {c}") for c, e in {
        "x": "i", "y": "vid % 2 + (i + vid) % 3", "tx": "1", "ty": "0", "z": "0", "s_px": "i", "r": "1 + vid % 3", "st": "1 + vid % 2", "peak": "1",
        "ds": "1"}.items()]))


def test_copies_in_cells_are_not_broadcast(spark):
    s = stored_samples(spark)
    for got in (J.candidate_pairs(s, "r + 2.75D * st + 0.5D"), J.pair_records(s), J.isolated(s), J.lumen_overlaps(s, 0.5), J.crossings(s)):
        assert "_part" not in broadcast_keys(got)
        assert got.count() > 0


def test_rows_by_position_are_not_broadcast(spark):
    """Stored rows whose files are small, and lists of positions made of a few of them."""
    s = checkpointed(spark.range(400_000).selectExpr("0L as image_id", "id div 400 as vid", "id % 400 as i", "0.0D as x"))
    iv = checkpointed(spark.range(1000).selectExpr("0L as image_id", "id as vid", "0L as lo", "399L as hi"))
    assert broadcast_keys(R.interval_samples(iv, s, R.EDGE)) == ""
    short = s.withColumn("_ck", F.expr("i div 2"))
    assert broadcast_keys(running(short, R.EDGE, ["i"], "_ck", {"n": ("sum", "1L")})) == ""


def test_records_reach_as_far_as_the_widest_gap(spark):
    """A record at the very end of the reach is found, with blurs that differ and the least ratio of radius to blur."""
    gap = 2.73 * (0.5 * (0.5 ** 2 + 2.0 ** 2)) ** 0.5
    at = [(0.0, 0), (1e-9 + gap - 1e-6, 1), (gap + 1e-6, 2)]
    rows = [(0, v, 0, x, 0.0, 0.0, 1.0, 1e-9, 0.5 if v == 0 else 2.0) for x, v in at]
    s = spark.createDataFrame(rows, "image_id long, vid long, i long, x double, y double, tx double, ty double, r double, st double")
    got = {(r.a, r.b) for r in J.pair_records(s).collect()}
    assert (0, 1) in got and (1, 0) in got and (0, 2) not in got
