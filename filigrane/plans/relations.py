"""Queries joining samples, junctions and annotations in space, and scoring annotations."""
from __future__ import annotations

from pyspark.sql import functions as F

from filigrane import tables as T
from filigrane.functions import columns as C
from filigrane.operators import paths as P
from filigrane.operators import relate as J
from filigrane.operators import runs as R
from filigrane.operators import scoring as G
from filigrane.operators.grid import near_positions
from filigrane.operators.quantile import quantiles
from filigrane.operators.scan import at_positions
from filigrane.plans import oracle
from filigrane.plans.registry import query
from filigrane.plans.sequences import _cores
from filigrane.session import checkpointed
from filigrane.sources import views as V

D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"


@query("jn01_close_pairs", "obs_junctions", f"""
  select a.image_id, a.jid as a, b.jid as b from obs_junctions a join obs_junctions b
    on a.image_id = b.image_id and a.jid < b.jid
  where sqrt({D2}) < a.radius / 4 + b.radius / 4 + 0.5""")
def jn01(spark, sf):
    p = V.obs_junctions(spark, sf).selectExpr("image_id", "jid", "x", "y", "radius / 4 as r")
    return J.close_pairs(p, "jid", 0.5).selectExpr("image_id", "a_jid as a", "b_jid as b")


@query("set01_unique_pairs", "obs_junctions", f"""
  select image_id, a, b, count(*) as n from (
   select distinct a.image_id, least(a.type, b.type) as a, greatest(a.type, b.type) as b, a.jid + b.jid as s
   from obs_junctions a join obs_junctions b on a.image_id = b.image_id and a.jid < b.jid
   where sqrt({D2}) < a.radius / 4 + b.radius / 4 + 0.5) group by image_id, a, b""")
def set01(spark, sf):
    """Unordered pairs once: packed as (smaller, larger) and made distinct, then counted per type pair."""
    p = V.obs_junctions(spark, sf).selectExpr("image_id", "jid", "x", "y", "radius / 4 as r", "type")
    d = J.close_pairs(p, "jid", 0.5).selectExpr(
        "image_id", "cast(least(a_type, b_type) as bigint) as a", "cast(greatest(a_type, b_type) as bigint) as b",
        "a_jid + b_jid as s").distinct()
    return d.groupBy("image_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))


H = "{0}.r + 2.75 * {0}.st + 0.5"
oracle.define("cand", ("samples",), f"""
  select a.image_id, a.vid as a, b.vid as b, a.i, b.i as j, a.x as ax, a.y as ay, a.tx as atx, a.ty as aty, a.r as ar,
    a.st as ast, b.x as bx, b.y as byy, b.r as br, b.st as bst
  from samples a join samples b on a.image_id = b.image_id and a.vid <> b.vid
    and abs(a.x - b.x) <= 20 and abs(a.y - b.y) <= 20
  where sqrt({D2}) < {H.format('a')} + {H.format('b')}""")
oracle.define("records", ("cand",), f"""
  select image_id, a, b, i, j, d < br + g as unresolved, d < br as overlap from (
    select *, sqrt(power(wx + t * aty, 2) + power(wy - t * atx, 2)) as d, {C.g_res('ar', 'br', 'ast', 'bst')} as g from (
      select *, least(greatest(wx * -aty + wy * atx, -ar), ar) as t from (
        select *, bx - ax as wx, byy - ay as wy from cand)))
  where d < br + g""")


@query("jn02_candidate_pairs", "cand", """
  select image_id, a, b, count(*) as n, cast(sum(i * 7 + j) as bigint) as chk from cand where a < b
  group by image_id, a, b""")
def jn02(spark, sf):
    s = V.samples(spark, sf).select("image_id", "vid", "i", "x", "y", "r", "st")
    p = J.candidate_pairs(s, "r + 2.75D * st + 0.5D")
    return p.groupBy("image_id", F.col("a_vid").alias("a"), F.col("b_vid").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.expr("sum(a_i * 7 + b_i)").alias("chk"))


@query("jn04_pair_records", "records", """
  select image_id, a, b, count(*) filter (unresolved) as n_res, count(*) filter (overlap) as n_lum,
    min(i) as i0, max(i) as i1, min(j) as j0, max(j) as j1 from records group by image_id, a, b""")
def jn04(spark, sf):
    rec = J.pair_records(V.samples(spark, sf))
    return rec.groupBy("image_id", "a", "b").agg(
        F.expr("count_if(unresolved)").alias("n_res"), F.expr("count_if(overlap)").alias("n_lum"),
        F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))


oracle.define("rec_runs", ("records",), """
  select image_id, a, b, min(i) as i0, max(i) as i1, min(j) as j0, max(j) as j1, count(*) as n from (
    select *, sum(case when p is null or i - p > 3 then 1 else 0 end)
        over (partition by a, b order by i, j rows unbounded preceding) as g
    from (select *, lag(i) over (partition by a, b order by i, j) as p from records)) group by image_id, a, b, g""")


@query("run04_record_runs", "rec_runs", "select * from rec_runs")
def run04(spark, sf):
    return R.record_runs(checkpointed(J.pair_records(V.samples(spark, sf))))


@query("jn05_isolated_samples", "samples", f"""
  select s.image_id, s.vid, s.i, not coalesce(f.hc or (f.hl and f.hr), false) as isolated from samples s left join (
    select a.vid, a.i, bool_or(sqrt({D2}) < b.r + 2 * b.st) as hc,
      bool_or(sqrt(power(a.x + f * -a.ty - b.x, 2) + power(a.y + f * a.tx - b.y, 2)) < b.r + 2 * b.st) as hl,
      bool_or(sqrt(power(a.x - f * -a.ty - b.x, 2) + power(a.y - f * a.tx - b.y, 2)) < b.r + 2 * b.st) as hr
    from (select *, r + 2.5 * st + 1 as f from samples) a join samples b on a.image_id = b.image_id and a.vid <> b.vid
      and abs(a.x - b.x) <= 30 and abs(a.y - b.y) <= 30 and b.peak >= 0.2 * a.peak
    where sqrt({D2}) < greatest(f, a.r + 2 * a.st) + greatest(b.r + 2.5 * b.st + 1, b.r + 2 * b.st)
    group by a.vid, a.i) f on f.vid = s.vid and f.i = s.i""")
def jn05(spark, sf):
    return J.isolated(V.samples(spark, sf))


oracle.define("crossings", ("samples",), """
  select image_id, a, b, i, j, x, y, s_a, s_b, z_a, z_b, above, r_a, r_b, angle_deg from (
    select *, row_number() over (partition by a, b, round(x * 4), round(y * 4) order by i, j) as k from (
      select image_id, a, b, i, j, ax + ta * (ax1 - ax) as x, ay + ta * (ay1 - ay) as y, i + ta as s_a, j + tb as s_b,
        z_a, z_b, case when z_a <= z_b then a else b end as above, r_a, r_b,
        degrees(acos(least(1.0, abs(atx * btx + aty * bty)))) as angle_deg
      from (select *, ((bx - ax) * (by1 - b_y) - (b_y - ay) * (bx1 - bx)) / den as ta,
          ((bx - ax) * (ay1 - ay) - (b_y - ay) * (ax1 - ax)) / den as tb
        from (select a.image_id, a.vid a, b.vid b, a.i, b.i j, a.x ax, a.y ay, a.x1 ax1, a.y1 ay1, b.x bx, b.y b_y,
            b.x1 bx1, b.y1 by1, a.z z_a, b.z z_b, a.r r_a, b.r r_b, a.tx atx, a.ty aty, b.tx btx, b.ty bty,
            (a.x1 - a.x) * (b.y1 - b.y) - (a.y1 - a.y) * (b.x1 - b.x) as den
          from seg a join seg b on a.image_id = b.image_id and a.vid < b.vid and abs(a.x - b.x) <= 6
            and abs(a.y - b.y) <= 6)
        where abs(den) >= 1e-12) where ta >= 0 and ta < 1 and tb >= 0 and tb < 1)) where k = 1""")
oracle.define("seg", ("samples",), """
  select * from (select *, lead(x) over (partition by vid order by i) as x1, lead(y) over (partition by vid order by i)
    as y1 from samples) where x1 is not null""")
oracle.VIEWS["crossings"] = (("seg",), oracle.VIEWS["crossings"][1])


@query("jn03_crossings", "crossings", """
  select image_id, a, b, i, j, round(x, 6) as x, round(y, 6) as y, round(s_a, 6) as s_a, round(s_b, 6) as s_b,
    z_a, z_b, above, round(angle_deg, 6) as angle_deg from crossings""")
def jn03(spark, sf):
    c = J.crossings(V.samples(spark, sf))
    return c.selectExpr("image_id", "a", "b", "i", "j", "round(x, 6) as x", "round(y, 6) as y", "round(s_a, 6) as s_a",
                        "round(s_b, 6) as s_b", "z_a", "z_b", "above", "round(angle_deg, 6) as angle_deg")


oracle.define("knots", ("samples",), """
  select vid, vid as node, x, y, 6.0 + vid % 5 as reach from samples where i = 0
  union all
  select l.vid, l.vid + 1, coalesce(s.x, l.x), coalesce(s.y, l.y), 6.0 + (l.vid + 1) % 5
  from (select vid, arg_max(x, i) as x, arg_max(y, i) as y from samples group by vid) l
  left join samples s on s.vid = l.vid + 1 and s.i = 0""")
oracle.define("crossings_off_nodes", ("seg", "knots"), oracle.VIEWS["crossings"][1].replace("tb < 1)) where k = 1", """tb < 1) q
  where not exists (select 1 from knots e join knots f on f.node = e.node where e.vid = q.a and f.vid = q.b
    and (sqrt(power(q.x - e.x, 2) + power(q.y - e.y, 2)) < 3 * greatest(q.r_a, q.r_b)
      or (abs(z_a - z_b) < r_a + r_b and sqrt(power(q.x - e.x, 2) + power(q.y - e.y, 2)) < e.reach)))) where k = 1"""))


def _knots(s):
    """Edges with successive numbers share a node, at the start of the later one."""
    start = s.where("i = 0").selectExpr("vid as node", "x as sx", "y as sy")
    last = s.groupBy("vid").agg(F.expr("max_by(struct(x, y), i)").alias("p")).selectExpr("vid", "vid + 1 as node", "p.x as x", "p.y as y")
    return (start.selectExpr("node as vid", "node", "sx as x", "sy as y").unionByName(
        last.join(start, "node", "left").selectExpr("vid", "node", "coalesce(sx, x) as x", "coalesce(sy, y) as y"))
        .withColumn("reach", F.expr("6.0D + node % 5")))


@query("jn03_crossings_off_nodes", "crossings_off_nodes", """
  select image_id, a, b, i, j, round(x, 6) as x, round(y, 6) as y, above, round(angle_deg, 6) as angle_deg from crossings_off_nodes""")
def jn03_off(spark, sf):
    """Crossings, but for those at a node that both edges share."""
    s = V.samples(spark, sf)
    return J.crossings(s, _knots(s)).selectExpr("image_id", "a", "b", "i", "j", "round(x, 6) as x", "round(y, 6) as y", "above",
                                                "round(angle_deg, 6) as angle_deg")


@query("jn20_arcade_crossings", "crossings", """,
  e as (select vid, arg_min(x, i) x0, arg_min(y, i) y0, arg_max(x, i) x1, arg_max(y, i) y1 from samples group by vid),
  c as (select image_id, a as arcade, b as host, x, y, r_a, r_b from crossings
    union all select image_id, b, a, x, y, r_a, r_b from crossings)
  select c.image_id, arcade, count(*) as n_far from c join e on e.vid = c.arcade
  where least(sqrt(power(x - x0, 2) + power(y - y0, 2)), sqrt(power(x - x1, 2) + power(y - y1, 2)))
    > 3 * (r_a + r_b) + 2 group by c.image_id, arcade""")
def jn20(spark, sf):
    """Edges that cross another away from their own ends, with the number of such crossings."""
    s = V.samples(spark, sf)
    e = s.groupBy(F.col("vid").alias("arcade")).agg(
        F.expr("min_by(struct(x, y), i)").alias("p"), F.expr("max_by(struct(x, y), i)").alias("q"))
    c = J.crossings(s).select("image_id", "a", "b", "x", "y", "r_a", "r_b")
    c = c.withColumn("arcade", F.explode(F.array("a", "b")))
    d = ("least(sqrt(power(x - p.x, 2) + power(y - p.y, 2)), sqrt(power(x - q.x, 2) + power(y - q.y, 2))) "
         "> 3 * (r_a + r_b) + 2")
    return c.join(e, "arcade").where(d).groupBy("image_id", "arcade").agg(F.count(F.lit(1)).alias("n_far"))


@query("src07_crossings_in_frame", "crossings", """
  select image_id, above, count(*) as n, round(min(x * 4), 6) as x_min_px, round(max(y * 4), 6) as y_max_px
  from crossings where x between -0.5 and 159.5 and y between -0.5 and 99.5 group by image_id, above""")
def src07(spark, sf):
    """Crossings inside the frame with px coordinates (k = 4), counted by the edge on top."""
    c = J.crossings(V.samples(spark, sf)).where(C.doubles(C.in_frame("x", "y", 160, 100)))
    return c.groupBy("image_id", "above").agg(F.count(F.lit(1)).alias("n"), F.expr("round(min(x * 4), 6)").alias(
        "x_min_px"), F.expr("round(max(y * 4), 6)").alias("y_max_px"))


@query("jn06_nearest_traced", "samples tracings", """
  select s.image_id, s.vid, s.i, round(sqrt(min(power(s.x - t.x, 2) + power(s.y - t.y, 2))), 6) as distance
  from samples s join tracings t on t.image_id = s.image_id and abs(s.x - t.x) <= 3 and abs(s.y - t.y) <= 3
  where power(s.x - t.x, 2) + power(s.y - t.y, 2) <= 9 group by s.image_id, s.vid, s.i""")
def jn06(spark, sf):
    s = V.samples(spark, sf)
    t = s.selectExpr("image_id", "x + vid % 5 as x", "y - vid % 3 as y").distinct()
    n = J.nearest_within(s.select("image_id", "vid", "i", "x", "y"), t, 3.0, ["vid", "i"], "b_x")
    return n.selectExpr("image_id", "vid", "i", "round(distance, 6) as distance")


@query("jn07_nearest_junction", "obs_junctions", f"""
  select image_id, jid, round(sqrt(m.d2), 6) as distance, round(sqrt(m.d2) - radius - m.r, 6) as gap, m.b as nearest from (
    select a.image_id, a.jid, a.radius, min({{'d2': {D2}, 'b': b.jid, 'r': b.radius}}) as m
    from obs_junctions a join obs_junctions b on a.image_id = b.image_id and a.jid <> b.jid
    group by a.image_id, a.jid, a.radius)""")
def jn07(spark, sf):
    j = V.obs_junctions(spark, sf).select("image_id", "jid", "x", "y", "radius")
    n = J.nearest_any(j, j, "jid", "struct(b_jid, b_radius)", 8.0, on="a_jid <> b_jid")
    return n.join(j, ["image_id", "jid"]).selectExpr(
        "image_id", "jid", "round(distance, 6) as distance", "round(distance - radius - nearest.b_radius, 6) as gap",
        "nearest.b_jid as nearest")


@query("jn08_lumen_overlaps", "samples", f"""
  select distinct a.image_id, a.vid as a, b.vid as b, a.vid = b.vid as itself from samples a join samples b
    on a.image_id = b.image_id and a.vid <= b.vid and abs(a.x - b.x) <= 7 and abs(a.y - b.y) <= 7
  where (a.vid < b.vid and sqrt({D2}) < a.r + b.r + 0.5 and abs(a.z - b.z) < a.r + b.r + 0.5)
    or (a.vid = b.vid and a.i < b.i and sqrt({D2}) < a.r + b.r and abs(a.s_px - b.s_px) > pi() * (a.r + b.r))""")
def jn08(spark, sf):
    return J.lumen_overlaps(V.samples(spark, sf), 0.5)


@query("jn08_overlaps_off_nodes", "samples knots", f"""
  select distinct a.image_id, a.vid as a, b.vid as b, a.vid = b.vid as itself from samples a join samples b
    on a.image_id = b.image_id and a.vid <= b.vid and abs(a.x - b.x) <= 7 and abs(a.y - b.y) <= 7
  where (a.vid < b.vid and sqrt({D2}) < a.r + b.r + 0.5 and abs(a.z - b.z) < a.r + b.r + 0.5
      and not exists (select 1 from knots e join knots f on f.node = e.node where e.vid = a.vid and f.vid = b.vid
        and greatest(sqrt(power(a.x - e.x, 2) + power(a.y - e.y, 2)), sqrt(power(b.x - e.x, 2) + power(b.y - e.y, 2))) < e.reach))
    or (a.vid = b.vid and a.i < b.i and sqrt({D2}) < a.r + b.r and abs(a.s_px - b.s_px) > pi() * (a.r + b.r))""")
def jn08_off(spark, sf):
    """Lumen overlaps, but for those within the reach of a node that both edges share."""
    s = V.samples(spark, sf)
    return J.lumen_overlaps(s, 0.5, _knots(s))


@query("jn09_fading_ends", "obs", f"""
  select image_id, vid, i, sgn, round(greatest(m.g, 0), 6) as gap_px, m.v as onto, m.j as onto_i from (
    select a.image_id, a.vid, a.i, a.sgn, min({{'g': sqrt({D2}) - a.r - b.r, 'v': b.vid, 'j': b.i}}) as m
    from (select *, -1 as sgn from e where observable and not coalesce(pf, true) and pi
        union all select *, 1 from e where observable and not coalesce(nf, true) and ni) a
    join obs b on b.image_id = a.image_id and b.vid <> a.vid and b.observable and abs(a.x - b.x) <= 18
      and abs(a.y - b.y) <= 18
    where least(a.x + 0.5, 159.5 - a.x, a.y + 0.5, 99.5 - a.y) >= a.r + 2 * a.st + 2
      and sqrt({D2}) - a.r - b.r <= 11.9
      and (sqrt({D2}) < 1e-9 or case when sqrt({D2}) > 0 then ((b.x - a.x) * a.sgn * a.tx + (b.y - a.y) * a.sgn * a.ty)
         / sqrt({D2}) >= cos(radians(60)) end or sqrt({D2}) - a.r - b.r <= a.st)
    group by a.image_id, a.vid, a.i, a.sgn)""".replace("from e where", "from (select *, lag(observable) over w pf, "
        "lead(observable) over w nf, lag(in_frame) over w pi, lead(in_frame) over w ni from obs window w as "
        "(partition by vid order by i)) where"))
def jn09(spark, sf):
    s = checkpointed(R.observable(V.samples(spark, sf)))
    return J.fading_ends(s, "observable", 160, 100).withColumn("gap_px", F.expr("round(gap_px, 6)"))


@query("jn10_inside_taken", "claims", """
  select vid, cid, ln, lo, hi, exists (select 1 from claims t where t.vid = c.vid and t.hi - t.lo >= 48
    and t.lo <= c.hi and t.hi >= c.lo) as inside from claims c""")
def jn10(spark, sf):
    c = V.claims(spark, sf)
    return J.overlap_flag(c, c.where("hi - lo >= 48"), ["vid"]).select("vid", "cid", "ln", "lo", "hi", "inside")


@query("jn11_strong_overlaps", "claims", """
  select a.vid, a.cid as a, b.cid as b, a.lo as a_lo, b.lo as b_lo from claims a join claims b on a.vid = b.vid
    and row(a.lo, a.hi, a.cid) < row(b.lo, b.hi, b.cid) and a.cid <> b.cid and b.lo <= a.hi
  where least(a.hi, b.hi) - b.lo + 1 >= 0.5 * least(a.hi - a.lo + 1, b.hi - b.lo + 1)""")
def jn11(spark, sf):
    return J.overlapping_pairs(V.claims(spark, sf), ["vid"], "cid", 0.5).selectExpr(
        "vid", "a_cid as a", "b_cid as b", "a_lo", "b_lo")


oracle.define("truth_events", (), """
  select o_orderkey as id, o_orderstatus as kind, least(o_custkey % 40, o_orderkey % 40) as va,
    greatest(o_custkey % 40, o_orderkey % 40) as vb, case when o_orderpriority = '1-URGENT' then o_custkey end as node,
    cast((o_orderkey * 37) % 160 as double) as x, cast((o_orderkey * 53) % 100 as double) as y,
    o_totalprice > 250000 as shown from orders""")


@query("jn12_same_event", "truth_events", f"""
  select a.id as a, b.id as b from truth_events a join truth_events b on a.node = b.node where a.shown
  union
  select a.id, b.id from truth_events a join truth_events b on a.kind = b.kind and a.va = b.va and a.vb = b.vb
    and a.node is null and b.node is null where a.shown and sqrt({D2}) <= 11.9""")
def jn12(spark, sf):
    """Events of one rule set found again under another: at the same node, or the same kind of event of the same two
    edges within lambda."""
    e = V.table(spark, sf, "orders").selectExpr(
        "o_orderkey as id", "o_orderstatus as kind", "least(o_custkey % 40, o_orderkey % 40) as va",
        "greatest(o_custkey % 40, o_orderkey % 40) as vb",
        "case when o_orderpriority = '1-URGENT' then o_custkey end as node",
        "cast((o_orderkey * 37) % 160 as double) as x", "cast((o_orderkey * 53) % 100 as double) as y",
        "o_totalprice > 250000 as shown")
    n = e.where("node is not null").select("node", "id", "shown")
    by_node = (n.where("shown").withColumnRenamed("id", "a").join(n.selectExpr("node", "id as b"), "node")
               .select("a", "b"))
    rest = e.where("node is null")
    k = ["kind", "va", "vb"]
    near = J.grid_join(J.tag(rest.where("shown").select(*k, "id", "x", "y"), "a", k),
                       J.tag(rest.select(*k, "id", "x", "y"), "b", k), T.LAMBDA_PX,
                       f"sqrt({J.D2}) <= {T.LAMBDA_PX}D", k)
    return by_node.unionByName(near.selectExpr("a_id as a", "b_id as b"))


def match_sql(truth: str) -> str:
    """Traced junctions one after the other, each with its nearest free true one: (image_id, tj, jid)."""
    return f"""
  w as (select a.image_id, a.tj, list(b.jid order by {D2}, b.jid) as near from traced_junctions a join {truth} b
      on a.image_id = b.image_id and sqrt({D2}) <= greatest(b.radius, {T.LAMBDA_PX}) group by a.image_id, a.tj),
  o as (select *, row_number() over (partition by image_id order by tj) as n from w),
  matched as (select image_id, tj, jid from (
    with recursive walk as (
      select distinct image_id, 0::bigint as n, []::bigint[] as taken, null::bigint as tj, null::bigint as jid from o
      union all
      select image_id, n, case when jid is null then taken else list_append(taken, jid) end, tj, jid from (
        select o.image_id, o.n, v.taken, o.tj, list_filter(o.near, lambda x: not list_contains(v.taken, x))[1] as jid
        from walk v join o on o.image_id = v.image_id and o.n = v.n + 1))
    select * from walk) where jid is not null)"""


@query("jn13_match_in_order", "traced_junctions obs_junctions", ", " + match_sql("obs_junctions") + " select * from matched")
def jn13(spark, sf):
    t, j = V.traced_junctions(spark, sf), V.obs_junctions(spark, sf)
    c = J.within_radius(t, j, T.LAMBDA_PX)
    c = c.selectExpr("image_id", "a_tj as tj", "b_jid as jid", f"sqrt({J.D2}) as d", "a_tj as ord")
    return J.match_in_order(c, "tj", "jid", "d", "ord")


@query("jn14_companions", "samples", f""",
  n as (select a.image_id, a.vid, a.i, min({{'d2': {D2}, 'v': b.vid}}) as m from samples a
    join samples b on a.image_id = b.image_id and b.vid <> a.vid and abs(a.x - b.x) <= 8 and abs(a.y - b.y) <= 8
    where {D2} <= 7.4 * 7.4 group by a.image_id, a.vid, a.i),
  c as (select image_id, vid, m.v as host, count(*) as n from n group by image_id, vid, host)
  select c.image_id, c.vid, arg_max(host, {{'n': n, 'h': -host}}) as partner, cast(sum(n) as bigint) as n_near, t.n_all
  from c join (select vid, count(*) as n_all from samples group by vid) t on t.vid = c.vid
  group by c.image_id, c.vid, t.n_all having sum(n) >= 0.5 * t.n_all""")
def jn14(spark, sf):
    """Edges lying mostly beside other edges, with the one they run beside most."""
    s = V.samples(spark, sf).select("image_id", "vid", "i", "x", "y")
    n = J.nearest_within(s, s, 7.4, ["vid", "i"], "b_vid", on="a_vid <> b_vid")
    c = n.groupBy("image_id", "vid", F.col("nearest").alias("host")).agg(F.count(F.lit(1)).alias("n"))
    t = s.groupBy("vid").agg(F.count(F.lit(1)).alias("n_all"))
    return (c.groupBy("image_id", "vid").agg(F.expr("max_by(host, struct(n, -host))").alias("partner"),
                                             F.sum("n").alias("n_near"))
            .join(t, "vid").where("n_near >= 0.5D * n_all")
            .select("image_id", "vid", "partner", "n_near", "n_all"))


@query("jn16_merge_partner", "rec_runs", f"""
  select r.image_id, r.a, r.b, r.i0, s.i, arg_min(p.i, {{'d2': power(s.x - p.x, 2) + power(s.y - p.y, 2), 'j': p.i}})
    as partner
  from rec_runs r join samples s on s.vid = r.a and s.i between r.i0 and r.i1
  join samples p on p.vid = r.b and p.i between r.j0 - 6 and r.j1 + 6 group by r.image_id, r.a, r.b, r.i0, s.i""")
def jn16(spark, sf):
    """For every sample of a run of records: the nearest sample of the other edge among those it is unresolved from,
    a few more on both sides. The two meet in the stretches of 64 positions that the other edge's run covers."""
    s = V.samples(spark, sf)
    r = checkpointed(R.record_runs(checkpointed(J.pair_records(s))))
    pos = s.select("image_id", "vid", "i", "x", "y")
    left = at_positions(r.withColumn("i", F.explode(F.expr("sequence(i0, i1)"))), pos.withColumnRenamed("vid", "a"), ["image_id", "a", "i"])
    k = ["image_id", "b", "_s"]
    left = left.withColumn("_s", F.explode(F.expr("sequence((j0 - 6) div 64, (j1 + 6) div 64)")))
    other = pos.selectExpr("image_id", "vid as b", "i div 64 as _s", "i", "x", "y")
    p = (at_positions(J.tag(left, "a", k), J.tag(other, "b", k), k).where("b_i between a_j0 - 6 and a_j1 + 6")
         .withColumnRenamed("b", "a_b"))
    return p.groupBy("image_id", F.col("a_a").alias("a"), F.col("a_b").alias("b"), F.col("a_i0").alias("i0"),
                     F.col("a_i").alias("i")).agg(F.expr(f"min_by(b_i, struct({J.D2}, b_i))").alias("partner"))


@query("jn17_class_lookup", "", """
  select o_orderpriority as cls, o_orderstatus as side, count(*) as n, round(sum(l_quantity), 6) as length
  from lineitem join orders on o_orderkey = l_orderkey group by o_orderpriority, o_orderstatus""")
def jn17(spark, sf):
    """Class and side of every piece by its edge; pieces are summed per edge before they meet the edges."""
    li = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("vid")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("len"))
    o = V.table(spark, sf, "orders").selectExpr("o_orderkey as vid", "o_orderpriority as cls", "o_orderstatus as side")
    return li.join(o, "vid").groupBy("cls", "side").agg(F.sum("n").alias("n"),
                                                        F.expr("round(sum(len), 6)").alias("length"))


oracle.define("discs", ("cores",), """
  select c.image_id, c.jid, c.vid, s.i, s.x, s.y, s.r + s.st as w, sqrt(power(s.x - cx, 2) + power(s.y - cy, 2)) as d
  from cores c join samples s on s.vid = c.vid and s.i between c.lo and c.hi
  where sqrt(power(s.x - cx, 2) + power(s.y - cy, 2)) <= 23.8""")


@query("jn18_intersecting_regions", "discs", f"""
  select distinct a.image_id, a.jid as a, b.jid as b from discs a join discs b on a.image_id = b.image_id
    and a.jid < b.jid and abs(a.x - b.x) <= 12 and abs(a.y - b.y) <= 12
  where sqrt({D2}) < a.w + b.w""")
def jn18(spark, sf):
    """Event regions as the discs of their samples within 2 lambda of the centre: which of them intersect."""
    s = V.samples(spark, sf)
    d = _discs(s)
    p = J.reach_join(J.tag(d, "a"), J.tag(d, "b"), "a_w", "b_w", T.REACH_CLASSES, "a_jid < b_jid")
    return p.selectExpr("image_id", "a_jid as a", "b_jid as b").distinct()


def _discs(s):
    c = R.interval_samples(_cores(s), s.select("image_id", "vid", "i", "x", "y", "r", "st"), R.EDGE)
    c = c.selectExpr("image_id", "jid", "vid", "i", "x", "y", "r + st as w",
                     "sqrt(power(x - cx, 2) + power(y - cy, 2)) as d")
    return checkpointed(c.where(f"d <= {2 * T.LAMBDA_PX}D"))


@query("jn18_region_extent", "discs", """
  select image_id, jid, round(max(d + w), 6) as extent, count(*) as n from discs group by image_id, jid""")
def jn18_extent(spark, sf):
    d = _discs(V.samples(spark, sf))
    return d.groupBy("image_id", "jid").agg(F.expr("round(max(d + w), 6)").alias("extent"),
                                            F.count(F.lit(1)).alias("n"))


@query("jn19_orphans", "tree", """
  select 'leaf' as problem, nid as id from tree t where not exists (select 1 from tree c where c.parent = t.nid)
  union all select 'root without children', nid from tree t where parent is null
    and not exists (select 1 from tree c where c.parent = t.nid)
  union all select 'missing parent', nid from tree t where parent is not null
    and not exists (select 1 from tree c where c.nid = t.parent)""")
def jn19(spark, sf):
    t = V.tree(spark, sf)
    par = t.where("parent is not null").selectExpr("parent as nid").distinct()
    leaf = t.join(par, "nid", "left_anti")
    lost = t.where("parent is not null").join(t.selectExpr("nid as parent"), "parent", "left_anti")
    return (leaf.selectExpr("'leaf' as problem", "nid as id")
            .unionByName(leaf.where("parent is null").selectExpr("'root without children' as problem", "nid as id"))
            .unionByName(lost.selectExpr("'missing parent' as problem", "nid as id")))


oracle.define("path_ends", ("samples",), """
  select image_id, vid, 0 as side, x, y, tx * -1 as ux, ty * -1 as uy from samples where i = 0
  union all select s.image_id, s.vid, 1, x, y, tx, ty from samples s
    join (select vid, max(i) as n from samples group by vid) e on e.vid = s.vid and e.n = s.i""")


@query("jn22_gap_candidates", "path_ends", """
  select image_id, a, sa, b, sb, round(lat / 12 + dev / 30 + dist / 36, 6) as cost from (
    select *, degrees(acos(least(greatest(dot, -1.0), 1.0))) as dev,
      greatest(abs(dy * ux - dx * uy), abs(dy * vx - dx * vy)) as lat from (
      select a.image_id, a.vid a, a.side sa, b.vid b, b.side sb, a.ux, a.uy, b.ux vx, b.uy vy, b.x - a.x dx, b.y - a.y dy,
        -(a.ux * b.ux + a.uy * b.uy) as dot, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) as dist
      from path_ends a join path_ends b on a.image_id = b.image_id and a.vid < b.vid))
  where dist <= 36 and dot >= cos(radians(30)) and dx * ux + dy * uy >= -6 and -(dx * vx + dy * vy) >= -6
    and lat <= 6 + dist * sin(radians(30))""")
def jn22(spark, sf):
    """Pairs of path ends that may continue each other across a gap, with the cost of joining them (lambda 12)."""
    s = V.samples(spark, sf)
    n = s.groupBy("vid").agg(F.max("i").alias("n"))
    e = s.join(n, "vid").where("i = 0 or i = n").withColumn("side", F.explode(F.expr(
        "filter(array(0, 1), k -> (k = 0 and i = 0) or (k = 1 and i = n))"))).selectExpr(
        "image_id", "vid", "side", "x", "y", "case when side = 0 then -tx else tx end as ux",
        "case when side = 0 then -ty else ty end as uy")
    p = J.grid_join(J.tag(e, "a"), J.tag(e, "b"), 36.0, "a_vid < b_vid").selectExpr(
        "image_id", "a_vid as a", "a_side as sa", "b_vid as b", "b_side as sb", "a_ux as ux", "a_uy as uy",
        "b_ux as vx", "b_uy as vy", "b_x - a_x as dx", "b_y - a_y as dy").selectExpr(
        "*", "-(ux * vx + uy * vy) as dot", "sqrt(dx * dx + dy * dy) as dist",
        "greatest(abs(dy * ux - dx * uy), abs(dy * vx - dx * vy)) as lat").where(
        "dist <= 36 and dot >= cos(radians(30)) and dx * ux + dy * uy >= -6 and -(dx * vx + dy * vy) >= -6 "
        "and lat <= 6 + dist * sin(radians(30))")
    return p.selectExpr("image_id", "a", "sa", "b", "sb", "round(lat / 12 + degrees(acos(least(greatest(dot, -1.0D), "
                        "1.0D))) / 30 + dist / 36, 6) as cost")


@query("jn23_bilinear_lookup", "pixels", """
  select a.image_id, a.y, a.x, round(a.value * 0.7 * 0.4 + b.value * 0.7 * 0.6 + c.value * 0.3 * 0.4
    + d.value * 0.3 * 0.6, 6) as value
  from pixels a join pixels b on b.image_id = a.image_id and b.y = a.y and b.x = a.x + 1
  join pixels c on c.image_id = a.image_id and c.y = a.y + 1 and c.x = a.x
  join pixels d on d.image_id = a.image_id and d.y = a.y + 1 and d.x = a.x + 1""")
def jn23(spark, sf):
    """Values 0.3 px below and 0.6 px right of every pixel that has the four neighbours."""
    p = V.pixels(spark, sf)
    sites = p.selectExpr("image_id", "y", "x", "y + 0.3D as py", "x + 0.6D as px")
    return bilinear(sites, p, ["y", "x"]).where("n = 4").selectExpr("image_id", "y", "x", "round(value, 6) as value")


def bilinear(sites, pixels, ident):
    """Bilinear value at (py, px): every site asks its four pixels by equality; n corners found."""
    c = sites.withColumn("c", F.explode(F.expr(
        "array(struct(0L as dy, 0L as dx), struct(0L as dy, 1L as dx), struct(1L as dy, 0L as dx), "
        "struct(1L as dy, 1L as dx))"))).selectExpr(
        "image_id", *ident, "cast(floor(py) as long) + c.dy as _y", "cast(floor(px) as long) + c.dx as _x",
        "(case when c.dy = 1 then py - floor(py) else 1 - (py - floor(py)) end) "
        "* (case when c.dx = 1 then px - floor(px) else 1 - (px - floor(px)) end) as w")
    v = c.join(pixels.selectExpr("image_id", "y as _y", "x as _x", "value as _v"), ["image_id", "_y", "_x"])
    return v.groupBy("image_id", *ident).agg(F.expr("sum(w * _v)").alias("value"), F.count("_v").alias("n"))


@query("jn24_distance_to_mask", "raster", """,
  d as (select a.image_id, a.y, a.x, sqrt(min(power(a.y - b.y, 2) + power(a.x - b.x, 2))) as d
    from raster a join raster b on a.image_id = b.image_id and b.value <= 17 where a.value > 17
    group by a.image_id, a.y, a.x)
  select image_id, round(median(d), 6) as med, round(quantile_cont(d, 0.9), 6) as p90, round(max(d), 6) as far,
    count(*) as n from d group by image_id""")
def jn24(spark, sf):
    r = V.raster(spark, sf).selectExpr("image_id", "pid", "cast(y as double) as y", "cast(x as double) as x", "value")
    d = checkpointed(J.nearest_any(r.where("value > 17").select("image_id", "pid", "x", "y"),
                                   r.where("value <= 17").select("image_id", "x", "y"), "pid", "b_x", 2.0))
    q = quantiles(d, ["image_id"], "distance", {"med": 0.5, "p90": 0.9}, count="n")
    return q.join(d.groupBy("image_id").agg(F.max("distance").alias("far")), "image_id").selectExpr(
        "image_id", "round(med, 6) as med", "round(p90, 6) as p90", "round(far, 6) as far", "n")


# ------------------------------------------------------------------------------------------------ scoring
oracle.define("traced_pts", ("tracings",), """
  select image_id, line_id, k, m, case when x1 is null then x else x + m / n * (x1 - x) end as x,
    case when y1 is null then y else y + m / n * (y1 - y) end as y
  from (select *, unnest(range(n)) as m from (
    select *, case when x1 is null then 1 else cast(greatest(1, ceil(sqrt(power(x1 - x, 2) + power(y1 - y, 2)) / 0.5))
        as bigint) end as n
    from (select *, lead(x) over (partition by line_id order by k) as x1, lead(y) over (partition by line_id order by k)
        as y1 from tracings)))""")


def _traced(s):
    t = s.selectExpr("image_id", "vid as line_id", "i as k", "x + vid % 5 as x", "y - vid % 3 as y")
    return P.densify(t, ["image_id", "line_id"], 0.5)


@query("prj16_densify", "traced_pts", """
  select image_id, line_id, k, m, round(x, 6) as x, round(y, 6) as y from traced_pts""")
def prj16(spark, sf):
    return _traced(V.samples(spark, sf)).selectExpr("image_id", "line_id", "k", "cast(m as bigint) as m",
                                                    "round(x, 6) as x", "round(y, 6) as y")


NEAR = ("exists (select 1 from {o} o where o.image_id = p.image_id and o.x between p.x - 3 and p.x + 3 and o.y between "
        "p.y - 3 and p.y + 3 and (o.x - p.x) * (o.x - p.x) + (o.y - p.y) * (o.y - p.y) <= 9 {c})")


def _near(src, other, name, cond=""):
    """src with a flag by a join on the image (DuckDB flattens it to a hash join)."""
    return (f"(select distinct p.image_id, p.x, p.y from {src} p join {other} o on o.image_id = p.image_id "
            f"and o.x between p.x - 3 and p.x + 3 and o.y between p.y - 3 and p.y + 3 where (o.x - p.x) * (o.x - p.x) "
            f"+ (o.y - p.y) * (o.y - p.y) <= 9 {cond})")


oracle.define("tp", ("traced_pts",), "select distinct image_id, x, y from traced_pts")
oracle.define("score_hits", ("flags", "tp"), f"""
  select s.*, h.x is not null as hit from flags s
  left join {_near('(select distinct image_id, x, y from flags)', 'tp', 'h')} h
    on h.image_id = s.image_id and h.x = s.x and h.y = s.y""")


def _flagged(spark, sf):
    s = V.samples(spark, sf).select("image_id", "vid", "i", "ds", "x", "y", "cnr", "in_frame")
    return checkpointed(R.dont_care(s)), checkpointed(_traced(s))


@query("agg11_centreline_score", "score_hits", f""",
  g as (select t.*, ok.x is not null as ok, dc.x is not null as dc from traced_pts t
    left join {_near('tp', 'flags', 'ok', 'and o.observable')} ok on ok.image_id = t.image_id and ok.x = t.x and ok.y = t.y
    left join {_near('tp', 'flags', 'dc', 'and o.dont_care')} dc on dc.image_id = t.image_id and dc.x = t.x and dc.y = t.y),
  r as (select image_id, avg(hit::int) as recall, count(*) as n_truth from score_hits where observable group by image_id),
  p as (select image_id, avg(ok::int) filter (ok or not dc) as precision, count(*) as n_traced from g group by image_id)
  select coalesce(r.image_id, p.image_id) as image_id, round(recall, 6) as recall, round(precision, 6) as precision,
    round(case when recall + precision > 0 then 2 * recall * precision / (recall + precision) else 0 end, 6) as f1,
    n_truth, n_traced from r full join p on p.image_id = r.image_id""")
def agg11(spark, sf):
    s, t = _flagged(spark, sf)
    return G.centreline_score(s, t).selectExpr(
        "image_id", "round(recall, 6) as recall", "round(precision, 6) as precision", "round(f1, 6) as f1", "n_truth",
        "n_traced")


@query("agg11_junction_score", "traced_junctions obs_junctions", f"""
  , truth as (select * from obs_junctions where type <> 4), {match_sql("truth")},
  t as (select a.image_id, m.jid, a.type = j.type as same, exists (select 1 from obs_junctions b where b.type = 4
      and a.image_id = b.image_id and sqrt({D2}) <= greatest(b.radius, {T.LAMBDA_PX})) as ign
    from traced_junctions a left join matched m on m.image_id = a.image_id and m.tj = a.tj
    left join truth j on j.image_id = m.image_id and j.jid = m.jid),
  s as (select image_id, count(jid) as matched, count(*) as n_traced, count(*) filter (jid is null and not ign) as fp,
    count(*) filter (same) as type_ok from t group by image_id),
  n as (select image_id, count(*) as n_truth from truth group by image_id),
  r as (select coalesce(n.image_id, s.image_id) as image_id, coalesce(n_truth, 0) as n_truth, coalesce(matched, 0) as matched,
    coalesce(n_traced, 0) as n_traced, coalesce(fp, 0) as fp, coalesce(type_ok, 0) as type_ok from n full join s on s.image_id = n.image_id)
  select *, matched / nullif(n_truth, 0) as recall, matched / nullif(matched + fp, 0) as precision,
    type_ok / nullif(matched, 0) as type_accuracy, case when matched > 0 then 2 * (matched / n_truth) * (matched / (matched + fp))
      / (matched / n_truth + matched / (matched + fp)) else 0 end as f1 from r""")
def agg11_junctions(spark, sf):
    j = V.obs_junctions(spark, sf)
    truth, ignored = j.where("type <> 4"), j.where("type = 4")
    return G.junction_score(truth, V.traced_junctions(spark, sf), ignored)


@query("agg12_fit_score", "score_hits", """
  select image_id, level, vid, count(*) as n, round(avg(hit::int), 6) as recall from (
    select *, case when observable then 'observable' when dont_care then 'dont_care' else 'invisible' end as level
    from score_hits where in_frame)
  group by grouping sets ((image_id, level), (image_id, vid), (image_id))""")
def agg12(spark, sf):
    s, t = _flagged(spark, sf)
    return G.fit_score(s, t).withColumn("recall", F.expr("round(recall, 6)"))


@query("agg13_share_by_cnr", "score_hits", """
  select cast(bin as bigint) as bin, count(*) as n, round(avg(hit::int), 6) as share from (
    select *, """ + " + ".join(f"(cnr >= {b})::int" for b in T.CNR_BINS) + """ - 1 as bin
    from score_hits where in_frame) where bin between 0 and 12 group by bin""")
def agg13(spark, sf):
    s, t = _flagged(spark, sf)
    return G.share_by_cnr(near_positions(s.where("in_frame"), t, 3.0, dense=True)).withColumn("share", F.expr("round(share, 6)"))


NEWTON = ["n0 as (select 0.0::double as a, 1.0::double as b)"]
for _k in range(1, 16):
    NEWTON.append(f"""
  g{_k} as (select any_value(a) as a, any_value(b) as b, sum(t - p) as g0, sum((t - p) * lx) as g1, sum(w) + 1e-9 as h0,
      sum(w * lx) as h1, sum(w * lx * lx) + 1e-9 as h2
    from (select *, greatest(p * (1 - p), 1e-9) as w from (select *, 1 / (1 + exp(-(a + b * lx))) as p from d, n{_k - 1}))),
  n{_k} as (select a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) as a, b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) as b from g{_k})""")


@query("sta08_cnr_at_half", "score_hits", """
  , d as (select ln(greatest(cnr, 0.001)) as lx, hit::int::double as t from score_hits where in_frame), """ + ", ".join(NEWTON) + """
  select case when b > 0 and (select count(distinct t) from d) = 2 then round(exp(-a / b), 6) end as cnr50 from n15""")
def sta08(spark, sf):
    """CNR at which half of the in-frame samples are traced."""
    s, t = _flagged(spark, sf)
    c = G.cnr_at_half(near_positions(s.where("in_frame"), t, 3.0, dense=True))
    return spark.createDataFrame([(c,)], "cnr50 DOUBLE").selectExpr("round(cnr50, 6) as cnr50")


@query("prj14_observed_pieces", "obs", """,
  r as (select *, sum(case when p is null or i > p + 1 then 1 else 0 end) over (partition by vid order by i) as run from (
    select *, lag(i) over (partition by vid order by i) as p from obs where observable))
  select image_id, vid, run, min(i) as lo, max(i) as hi from (
    select *, i - row_number() over (partition by vid, run order by i) as g from r where cnr >= 1.5)
  group by image_id, vid, run, g""".replace("select image_id, vid, run, min(i)", "select image_id, vid, min(i)"))
def prj14(spark, sf):
    """Runs less the samples not seen in them: the pieces left."""
    d = R.observable(V.samples(spark, sf)).withColumn("seen_here", F.expr("observable and cnr >= 1.5"))
    return R.islands(checkpointed(d), R.EDGE, "seen_here").selectExpr("image_id", "vid", "run_start as lo",
                                                                      "run_end as hi")
