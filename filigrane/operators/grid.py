"""Distance joins by grid cells.

Every left point stays in its own cell; right points are copied into the 3 x 3 cells around theirs, so that all
partners closer than the cell size meet in exactly one cell and no pair comes out twice. Cells holding many right
points are split by a hash of the right row and the left points of those cells are copied once per part.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_CELL = 50_000


def tag(df: DataFrame, prefix: str, keys=("image_id",)) -> DataFrame:
    return df.select([F.col(c) if c in keys else F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def grid_join(a: DataFrame, b: DataFrame, cell: float, on: str, keys=("image_id",), hot: int = HOT_CELL,
              how: str = "inner", ax="a_x", ay="a_y", bx="b_x", by="b_y") -> DataFrame:
    """Pairs of a and b (columns already tagged apart, `keys` shared) whose points lie within `cell` of each other
    along both axes and that satisfy the condition `on`. Both sides are shuffled: a stored table looks small to the planner,
    but its decoded copies in nine cells, one set per pair of size classes, do not fit the driver as broadcasts."""
    keys = list(keys)
    cells = keys + ["_cx", "_cy"]
    near = F.expr("explode(array(-1L, 0L, 1L))")
    left = a.withColumn("_cx", F.expr(f"cast(floor({ax} / {cell!r}) as long)")) \
            .withColumn("_cy", F.expr(f"cast(floor({ay} / {cell!r}) as long)"))
    right = b.withColumn("_ox", near).withColumn("_oy", near) \
             .withColumn("_cx", F.expr(f"cast(floor({bx} / {cell!r}) as long) + _ox")) \
             .withColumn("_cy", F.expr(f"cast(floor({by} / {cell!r}) as long) + _oy")).drop("_ox", "_oy")
    # copies per cell, counted before they are made. At most one row per `hot` copies: sent to all tasks, so that the copies are shuffled
    # and sorted once, for the join itself
    alone = b.groupBy(*keys, F.expr(f"cast(floor({bx} / {cell!r}) as long)").alias("_cx"), F.expr(f"cast(floor({by} / {cell!r}) as long)").alias("_cy")).count()
    crowd = (alone.withColumn("_ox", near).withColumn("_oy", near)
             .groupBy(*keys, F.expr("_cx + _ox").alias("_cx"), F.expr("_cy + _oy").alias("_cy")).agg(F.sum("count").alias("count"))
             .where(F.col("count") > hot).selectExpr(*cells, f"cast(ceil(count / {hot}) as int) as _parts").hint("broadcast"))
    right = (right.join(crowd, cells, "left")
             .withColumn("_part", F.expr(f"case when _parts is null then 0L else pmod(xxhash64({', '.join(b.columns)}), _parts) end"))
             .drop("_parts"))
    left = (left.join(crowd, cells, "left")
            .withColumn("_part", F.explode(F.expr("sequence(0L, cast(coalesce(_parts, 1) - 1 as long))")))
            .drop("_parts"))
    return left.hint("merge").join(right.hint("merge"), cells + ["_part"], how).where(on).drop("_cx", "_cy", "_part")


def points(df: DataFrame, keys=("image_id",), x="x", y="y") -> DataFrame:
    """Distinct positions: what a nearest-distance question needs of the other side."""
    return df.select(*keys, F.col(x).alias("x"), F.col(y).alias("y")).distinct()


def near_positions(df: DataFrame, other: DataFrame, tol: float, keys=("image_id",), flag: str = "hit", dense: bool = False) -> DataFrame:
    """df with `flag`: some position of `other` lies within tol. Asked once per distinct position. The positions of `other`
    are copied into nine cells or, where there are many more of them (`dense`), those of df."""
    keys = list(keys)
    a, b = tag(points(df, keys), "a", keys), tag(points(other, keys), "b", keys)
    on = f"(a_x - b_x) * (a_x - b_x) + (a_y - b_y) * (a_y - b_y) <= {tol * tol!r}"
    p = grid_join(b, a, float(tol), on, keys, ax="b_x", ay="b_y", bx="a_x", by="a_y") if dense else grid_join(a, b, float(tol), on, keys)
    hits = p.selectExpr(*keys, "a_x as x", "a_y as y").distinct().withColumn(flag, F.lit(True))
    return df.join(hits.hint("merge"), keys + ["x", "y"], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def reach_classes(df: DataFrame, h: str, edges) -> DataFrame:
    """`_class`: index of the size class of the reach h, `_top`: the class's upper bound (last class: open)."""
    e = "case " + " ".join(f"when {h} < {v!r} then {k}" for k, v in enumerate(edges)) + f" else {len(edges)} end"
    return df.withColumn("_class", F.expr(e))


def reach_join(a: DataFrame, b: DataFrame, ha: str, hb: str, edges, on: str, keys=("image_id",)) -> DataFrame:
    """Pairs closer than ha + hb, one grid join per pair of size classes so that a few wide rows do not blow up
    the cells of the many narrow ones. Rows above the last edge are joined at the largest reach there is."""
    a, b = reach_classes(a, ha, edges), reach_classes(b, hb, edges)
    top = [float(e) for e in edges]
    present_a = {r[0]: r[1] for r in a.groupBy("_class").agg(F.max(F.expr(ha))).collect()}
    present_b = {r[0]: r[1] for r in b.groupBy("_class").agg(F.max(F.expr(hb))).collect()}
    out = None
    for ca, ma in sorted(present_a.items()):
        for cb, mb in sorted(present_b.items()):
            size = max(1.0, (min(top[ca], float(ma)) if ca < len(top) else float(ma))
                       + (min(top[cb], float(mb)) if cb < len(top) else float(mb)))
            part = grid_join(a.where(f"_class = {ca}").drop("_class"), b.where(f"_class = {cb}").drop("_class"), size,
                             f"sqrt((a_x - b_x) * (a_x - b_x) + (a_y - b_y) * (a_y - b_y)) < ({ha}) + ({hb}) "
                             f"and ({on})", keys)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else grid_join(a.drop("_class"), b.drop("_class"), 1.0, on, keys)
