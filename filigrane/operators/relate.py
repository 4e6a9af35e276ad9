"""Spatial relations between samples, edges and junctions, built on the grid join."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane import tables as T
from filigrane.functions import columns as C
from filigrane.operators.grid import HOT_CELL, grid_join, reach_join, tag
from filigrane.operators.paths import with_neighbours
from filigrane.operators.scan import CHUNK, halo, own
from filigrane.session import checkpointed

D2 = "(a_x - b_x) * (a_x - b_x) + (a_y - b_y) * (a_y - b_y)"


def close_pairs(pts: DataFrame, ident: str, gap: float, rsplit: float = 2.0, keys=("image_id",)) -> DataFrame:
    """Unordered pairs of points nearer than r_i + r_j + gap."""
    a, b = tag(pts, "a", keys), tag(pts, "b", keys)
    return reach_join(a, b, f"a_r + {gap / 2}D", f"b_r + {gap / 2}D", (rsplit + gap / 2,), f"a_{ident} < b_{ident}", keys)


def candidate_pairs(s: DataFrame, h: str, ordered: bool = False) -> DataFrame:
    """Pairs of samples of different edges nearer than h_a + h_b; both orders with `ordered`."""
    d = s.withColumn("h", F.expr(h))
    a, b = tag(d, "a"), tag(d, "b")
    return reach_join(a, b, "a_h", "b_h", T.REACH_CLASSES, "a_vid <> b_vid" if ordered else "a_vid < b_vid")


def pair_records(s: DataFrame) -> DataFrame:
    """(image_id, a, b, i, j, unresolved, overlap): the cross-section of a at i reaches b's sample j within the
    resolution gap / the lumen. The gap is at most G_RES_GAP[0] blurs, and a pair's blur at most sqrt(0.5) of the sum of both:
    centres farther apart than both reaches have no record."""
    reach = f"r + {T.G_RES_GAP[0] * math.sqrt(0.5) + 1e-3!r}D * st + 0.01D"
    p = candidate_pairs(s.select("image_id", "vid", "i", "x", "y", "tx", "ty", "r", "st"), reach, True)
    # blur, their ratio and the distance are made once per pair: as plain columns they would be written out in every branch of the
    # table lookup, in code too long to be compiled
    p = (p.withColumn("_wx", F.expr("b_x - a_x")).withColumn("_wy", F.expr("b_y - a_y"))
         .withColumn("_t", F.expr("least(greatest(_wx * -a_ty + _wy * a_tx, -a_r), a_r)"))
         .selectExpr("image_id", "a_vid as a", "b_vid as b", "a_i as i", "b_i as j", "b_r",
                     "inline(array(struct(" + ", ".join(C.doubles(f"{e} as {n}") for n, e in {
                         "_d": "sqrt(power(_wx + _t * a_ty, 2) + power(_wy - _t * a_tx, 2))",
                         "_blur": C.g_blur("a_st", "b_st"), "_rho": C.g_rho("a_r", "b_r", C.g_blur("a_st", "b_st"))}.items()) + ")))"))
    return (p.selectExpr("image_id", "a", "b", "i", "j", "_d < b_r + " + C.doubles(C.g_res_at("_rho", "_blur")) + " as unresolved",
                         "_d < b_r as overlap").where("overlap or unresolved"))


def isolated(s: DataFrame) -> DataFrame:
    """Samples whose centre and at least one flank no other edge of a fifth of their peak reaches."""
    d = s.selectExpr("image_id", "vid", "i", "x", "y", "tx", "ty", "peak", "r + 2.5D * st + 1 as dfl",
                     "r + 2 * st as reach").withColumn("h", F.expr("greatest(dfl, reach)"))
    p = reach_join(tag(d, "a"), tag(d, "b"), "a_h", "b_h", T.REACH_CLASSES,
                   "a_vid <> b_vid and b_peak >= 0.2D * a_peak")

    def hit(sign):
        return (f"sqrt(power(a_x + {sign} * a_dfl * -a_ty - b_x, 2) + power(a_y + {sign} * a_dfl * a_tx - b_y, 2)) "
                f"< b_reach")
    bad = p.groupBy("image_id", F.col("a_vid").alias("vid"), F.col("a_i").alias("i")).agg(
        F.expr(f"bool_or({hit(0)})").alias("c"), F.expr(f"bool_or({hit(1)})").alias("l"),
        F.expr(f"bool_or({hit(-1)})").alias("r"))
    return (s.select("image_id", "vid", "i").join(bad, ["image_id", "vid", "i"], "left")
            .selectExpr("image_id", "vid", "i", "not coalesce(c or (l and r), false) as isolated"))


CROSS_CELL = 8.0


def in_cells(seg: DataFrame, cell: float) -> DataFrame:
    """A segment (x, y) to (x_p1, y_p1) in every grid cell that it passes: column by column the rows between its ends there,
    so rows grow with its length and not with its box. A cell that it only touches may be among them."""
    def cells(lo, hi):
        return F.explode(F.expr(f"sequence(cast(floor(({lo}) / {cell!r}) as long), cast(floor(({hi}) / {cell!r}) as long))"))

    def at(bound):  # height of the segment at a column's border, or at its own end
        return f"y + (least(greatest({bound}, least(x, x_p1)), greatest(x, x_p1)) - x) / (x_p1 - x) * (y_p1 - y)"
    flat = "x_p1 = x"
    d = (seg.withColumn("_cx", cells("least(x, x_p1)", "greatest(x, x_p1)"))
         .withColumn("_ya", F.expr(f"case when {flat} then y else {at(f'_cx * {cell!r}')} end"))
         .withColumn("_yb", F.expr(f"case when {flat} then y_p1 else {at(f'(_cx + 1) * {cell!r}')} end")))
    return (d.withColumn("_cy", cells("greatest(least(_ya, _yb), least(y, y_p1)) - 1e-6D", "least(greatest(_ya, _yb), greatest(y, y_p1)) + 1e-6D"))
            .drop("_ya", "_yb"))


def meeting(seg: DataFrame, keys, on: str, hot: int) -> DataFrame:
    """Pairs (a_, b_) of rows of one cell (keys). The rows of a cell with more than `hot` are dealt to parts by a hash on one
    side and copied to each part on the other."""
    crowd = seg.groupBy(*keys).count().where(f"count > {hot}").selectExpr(*keys, f"ceil(count / {hot}) as _parts")
    # at most a row per `hot` segments
    s = seg.join(crowd.hint("broadcast"), keys, "left").withColumn("_parts", F.expr("coalesce(_parts, 1L)"))
    a = s.withColumn("_part", F.expr("pmod(xxhash64(vid, i), _parts)")).drop("_parts")
    b = s.withColumn("_part", F.explode(F.expr("sequence(0L, _parts - 1)"))).drop("_parts")
    both = [*keys, "_part"]
    return tag(a, "a", both).hint("merge").join(tag(b, "b", both).hint("merge"), both).where(on)  # never a broadcast of the copies


def edge_ends(ends: DataFrame) -> DataFrame:
    """vid and the nodes at its ends, from rows (vid, node, x, y, reach)."""
    return ends.groupBy("vid").agg(F.collect_set(F.struct("node", "x", "y", "reach")).alias("ends"))  # two per edge


def near_shared_node(p: DataFrame, ends: DataFrame, near: str) -> DataFrame:
    """Pairs of edges a and b with _near: `near`, a condition on a node n (x, y, reach), holds for a node at which both end."""
    e = edge_ends(ends)
    return (p.join(e.selectExpr("vid as a", "ends as _ea"), "a", "left").join(e.selectExpr("vid as b", "ends as _eb"), "b", "left")
            .withColumn("_near", F.expr(f"coalesce(exists(_ea, n -> exists(_eb, m -> m.node = n.node) and ({near})), false)"))
            .drop("_ea", "_eb"))


def crossings(s: DataFrame, ends: DataFrame | None = None, near_node: float | None = None, hot: int = HOT_CELL) -> DataFrame:
    """Where the polylines of two edges cross: point, positions along both, depths, which is on top, angle. Segments
    meet in the grid cells that both pass. A crossing found twice (in two cells, or within a quarter unit) counts once,
    the first by positions.

    With `ends` (vid, node, x, y, reach: the nodes at which edges end) crossings near a node that both edges share are left
    out: within near_node of it, or, where that is not given, within three times the wider edge's radius, or within the
    node's reach if the lumens overlap in depth."""
    seg = with_neighbours(s.select("image_id", "vid", "i", "x", "y", "z", "tx", "ty", "s_px", "r"),
                          ["image_id", "vid"], ["x", "y", "s_px"], [1]).where("x_p1 is not null")
    keys = ["image_id", "_cx", "_cy"]
    seg = in_cells(seg, CROSS_CELL)
    p = meeting(seg, keys, "a_vid < b_vid", hot)
    den = "((a_x_p1 - a_x) * (b_y_p1 - b_y) - (a_y_p1 - a_y) * (b_x_p1 - b_x))"
    p = (p.withColumn("_den", F.expr(den)).where("abs(_den) >= 1e-12")
         .withColumn("_ta", F.expr("((b_x - a_x) * (b_y_p1 - b_y) - (b_y - a_y) * (b_x_p1 - b_x)) / _den"))
         .withColumn("_tb", F.expr("((b_x - a_x) * (a_y_p1 - a_y) - (b_y - a_y) * (a_x_p1 - a_x)) / _den"))
         .where("_ta >= 0 and _ta < 1 and _tb >= 0 and _tb < 1"))
    p = p.selectExpr("image_id", "a_vid as a", "b_vid as b", "a_i as i", "b_i as j",
                     "a_x + _ta * (a_x_p1 - a_x) as x", "a_y + _ta * (a_y_p1 - a_y) as y",
                     "a_s_px + _ta * (a_s_px_p1 - a_s_px) as s_a", "b_s_px + _tb * (b_s_px_p1 - b_s_px) as s_b",
                     "a_z as z_a", "b_z as z_b", "case when a_z <= b_z then a_vid else b_vid end as above",
                     "a_r as r_a", "b_r as r_b",
                     C.doubles(C.acute_angle_deg("a_tx", "a_ty", "b_tx", "b_ty")) + " as angle_deg")
    if ends is not None:
        far = "hypot(x - n.x, y - n.y)"
        near = f"{far} < {near_node!r}D"
        if near_node is None:
            w = s.groupBy("vid").agg(F.max("r").alias("w"))
            p = p.join(w.selectExpr("vid as a", "w as _wa"), "a").join(w.selectExpr("vid as b", "w as _wb"), "b")
            near = f"{far} < 3 * greatest(_wa, _wb) or (abs(z_a - z_b) < r_a + r_b and {far} < n.reach)"
        p = near_shared_node(p, ends, near).where("not _near")
    first = p.groupBy("image_id", "a", "b", F.expr("cast(round(x * 4) as long)").alias("_qx"),
                      F.expr("cast(round(y * 4) as long)").alias("_qy")).agg(
        F.expr("min_by(struct(i, j, x, y, s_a, s_b, z_a, z_b, above, r_a, r_b, angle_deg), struct(i, j))").alias("c"))
    return first.select("image_id", "a", "b", "c.*")


def nearest_within(left: DataFrame, right: DataFrame, tol: float, ident, take: str, keys=("image_id",),
                   on: str = "true") -> DataFrame:
    """For every left row (ident columns, tagged a_) the right row nearest within tol: `take` of it (an expression
    over b_ columns) and the distance; ties by `take`."""
    p = grid_join(tag(left, "a", keys), tag(right, "b", keys), float(tol), f"{D2} <= {tol * tol!r} and ({on})", keys)
    return p.groupBy(*keys, *[f"a_{c}" for c in ident]).agg(
        F.expr(f"min(struct({D2} as d2, {take} as take))").alias("_m")).selectExpr(
        *keys, *[f"a_{c} as {c}" for c in ident], "sqrt(_m.d2) as distance", "_m.take as nearest")


def within_radius(points: DataFrame, centres: DataFrame, least: float) -> DataFrame:
    """Pairs (a_, b_) of points and centres with a `radius` that lie within the radius, or within `least`. Wide and
    narrow centres are joined class by class, so no radius is too large."""
    b = centres.withColumn("_reach", F.greatest(F.col("radius"), F.lit(float(least))))
    # reach_join keeps distances below the reach; a hair more, then the exact test
    return reach_join(tag(points, "a"), tag(b, "b"), "0.0D", "b__reach + 1e-6D", T.REACH_CLASSES,
                      f"sqrt({D2}) <= b__reach").drop("b__reach")


def nearest_any(left: DataFrame, right: DataFrame, ident: str, take: str, start: float,
                keys=("image_id",), on: str = "true") -> DataFrame:
    """Nearest right row at any distance: the search radius doubles for the rows still without one, until it spans
    everything there is."""
    both = left.select("x", "y").unionByName(right.select("x", "y"))
    limit = both.selectExpr("hypot(max(x) - min(x), max(y) - min(y))").first()[0] or 0.0
    todo, out, r = left, None, float(start)
    while True:
        found = checkpointed(nearest_within(todo, right, r, [ident], take, keys, on))
        out = found if out is None else out.unionByName(found)
        todo = checkpointed(todo.join(found.select(*keys, ident), [*keys, ident], "left_anti"))
        if r >= limit or todo.isEmpty():
            return out
        r *= 2


def lumen_overlaps(s: DataFrame, gap: float, ends: DataFrame | None = None) -> DataFrame:
    """Pairs of edges whose lumens overlap in depth too, and edges overlapping themselves far along themselves. With `ends`
    (vid, node, x, y, reach) places of which both samples lie within the reach of a node that both edges share are no
    overlap of theirs."""
    d = s.select("image_id", "vid", "i", "x", "y", "z", "r", "s_px")
    a, b = tag(d, "a"), tag(d, "b")
    lim = f"(a_r + b_r + {gap}D)"
    other = reach_join(a, b, f"a_r + {gap / 2}D", f"b_r + {gap / 2}D", (4.0,),
                       f"a_vid < b_vid and abs(a_z - b_z) < {lim}")
    itself = reach_join(a, b, "a_r", "b_r", (4.0,),
                        f"a_vid = b_vid and a_i < b_i and abs(a_s_px - b_s_px) > {math.pi!r}D * (a_r + b_r) "
                        f"and abs(a_z - b_z) < a_r + b_r")
    if ends is not None:
        far = "greatest(hypot(a_x - n.x, a_y - n.y), hypot(b_x - n.x, b_y - n.y))"
        other = near_shared_node(other.withColumnsRenamed({"a_vid": "a", "b_vid": "b"}), ends, f"{far} < n.reach").where(
            "not _near").withColumnsRenamed({"a": "a_vid", "b": "b_vid"})
    return (other.selectExpr("image_id", "a_vid as a", "b_vid as b", "false as itself").distinct()
            .unionByName(itself.selectExpr("image_id", "a_vid as a", "b_vid as b", "true as itself").distinct()))


def fading_ends(s: DataFrame, flag: str, w: int, h: int) -> DataFrame:
    """Ends of seen runs inside the frame with another seen edge ahead, wall to wall within lambda and 60 degrees."""
    d = halo(s, 2)
    from pyspark.sql import Window
    win = Window.partitionBy("image_id", "vid", "_c").orderBy("i")
    d = (d.withColumn("_pf", F.lag(flag).over(win)).withColumn("_nf", F.lead(flag).over(win))
         .withColumn("_pi", F.lag("in_frame").over(win)).withColumn("_ni", F.lead("in_frame").over(win)))
    d = own(d).where(flag)
    ends = (d.where("not _pf and _pi").withColumn("sgn", F.lit(-1))
            .unionByName(d.where("not _nf and _ni").withColumn("sgn", F.lit(1))))
    ends = ends.where(f"least(x + 0.5D, {w} - 0.5D - x, y + 0.5D, {h} - 0.5D - y) >= r + 2 * st + 2")
    a = tag(ends.select("image_id", "vid", "i", "sgn", "x", "y", "tx", "ty", "r", "st"), "a")
    b = tag(s.where(flag).select("image_id", "vid", "i", "x", "y", "r"), "b")
    lam = T.LAMBDA_PX
    cosmax = math.cos(math.radians(T.VIS_END_ANGLE_DEG))
    dist = f"sqrt({D2})"
    ahead = f"({dist} < 1e-9 or ((b_x - a_x) * a_sgn * a_tx + (b_y - a_y) * a_sgn * a_ty) / {dist} >= {cosmax!r}D)"
    p = reach_join(a, b, f"a_r + {lam}D", "b_r", (16.0,), "a_vid <> b_vid")
    p = p.withColumn("gap", F.expr(f"{dist} - a_r - b_r")).where(f"gap <= {lam}D and ({ahead} or gap <= a_st)")
    return (p.groupBy("image_id", F.col("a_vid").alias("vid"), F.col("a_i").alias("i"), F.col("a_sgn").alias("sgn"))
            .agg(F.expr("min(struct(gap, b_vid, b_i))").alias("m"))
            .selectExpr("image_id", "vid", "i", "sgn", "greatest(m.gap, 0.0D) as gap_px", "m.b_vid as onto",
                        "m.b_i as onto_i"))


BUCKET = 64


def _buckets(lo: str, hi: str) -> str:
    return f"explode(sequence({lo} div {BUCKET}, {hi} div {BUCKET}))"


def overlap_flag(iv: DataFrame, taken: DataFrame, keys, out: str = "inside") -> DataFrame:
    """Whether an interval overlaps any interval of `taken`. Those are merged first, so an interval meets few."""
    from filigrane.operators.runs import merge_intervals
    keys = list(keys)
    t = merge_intervals(taken, keys).selectExpr(*keys, "lo as tlo", "hi as thi").withColumn(
        "_b", F.expr(_buckets("tlo", "thi")))
    d = iv.withColumn("_id", F.expr("struct(*)")).withColumn("_b", F.expr(_buckets("lo", "hi")))
    hit = d.join(t, keys + ["_b"]).where("tlo <= hi and thi >= lo").select("_id").distinct().withColumn(out, F.lit(True))
    return (iv.withColumn("_id", F.expr("struct(*)")).join(hit, "_id", "left").drop("_id")
            .withColumn(out, F.coalesce(out, F.lit(False))))


def overlapping_pairs(iv: DataFrame, keys, owner: str, share: float) -> DataFrame:
    """Pairs of intervals of different owners that overlap by at least `share` of the shorter one. A pair is made
    only in the bucket where the later of the two begins."""
    keys = list(keys)
    d = iv.withColumn("_b", F.expr(_buckets("lo", "hi")))
    a, b = tag(d, "a", keys + ["_b"]), tag(d, "b", keys + ["_b"])
    return (a.join(b, keys + ["_b"]).where(
        f"struct(a_lo, a_hi, a_{owner}) < struct(b_lo, b_hi, b_{owner}) and a_{owner} <> b_{owner} "
        f"and b_lo <= a_hi and _b = greatest(a_lo, b_lo) div {BUCKET} "
        f"and least(a_hi, b_hi) - b_lo + 1 >= {share}D * least(a_hi - a_lo + 1, b_hi - b_lo + 1)").drop("_b"))


def match_in_order(cand: DataFrame, left: str, right: str, cost: str, order: str, keys=("image_id",)) -> DataFrame:
    """One-to-one matching where the left rows, in order, take their cheapest free right row.

    Done without going through the rows one by one: every free left row asks for its cheapest remaining right row,
    a right row keeps the earliest in order that asked, and nobody later in order may have it any more. This ends
    in the same matching. cand: keys, left, right, cost, order."""
    keys = list(keys)
    cand = checkpointed(cand.select(*keys, left, right, cost, order))
    while True:
        ask = cand.groupBy(*keys, left).agg(F.expr(f"min_by({right}, struct({cost}, {right}))").alias(right),
                                            F.min(order).alias(order))
        held = checkpointed(ask.groupBy(*keys, right).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")))
        if held.where("_n > 1").isEmpty():
            return checkpointed(ask.select(*keys, left, right))
        cand = checkpointed(cand.join(held.drop("_n"), [*keys, right], "left")
                            .where(f"_first is null or {order} <= _first").drop("_first"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["CHUNK"]
