"""Queries for events, junctions and observable lines, and whole-image runs."""
from __future__ import annotations

from pyspark.sql import functions as F

from filigrane import tables as T
from filigrane.operators import events as V2
from filigrane.operators import lines as L
from filigrane.operators import relate as J
from filigrane.operators import rules as U
from filigrane.operators import runs as R
from filigrane.operators import truth as G
from filigrane.plans import oracle
from filigrane.plans.networks import _deg
from filigrane.plans.registry import query
from filigrane.plans.sequences import _cores, core_owner, split_edges
from filigrane.session import checkpointed
from filigrane.sources import views as V

E = list(R.EDGE)


@query("rul01_node_events", "kinds vessels", """
  , k as (select nid, node_kind from kinds where in_degree + out_degree >= 3 and x between -48.5 and 207.5
    and y between -48.5 and 147.5)
  select k.nid, k.node_kind, v.vid, 'parent' as role from k join vessels v on v.v = k.nid
  union all select k.nid, k.node_kind, v.vid, 'child' from k join vessels v on v.u = k.nid""")
def rul01(spark, sf):
    """Nodes near the frame where three or more edges meet, with their parents and children."""
    k = _deg(spark, sf).where("in_degree + out_degree >= 3 and x between -48.5D and 207.5D and y between -48.5D and 147.5D"
                              ).select("nid", "node_kind")
    v = V.vessels(spark, sf)
    return (k.join(v.selectExpr("v as nid", "vid", "'parent' as role"), "nid")
            .unionByName(k.join(v.selectExpr("u as nid", "vid", "'child' as role"), "nid"))
            .select("nid", "node_kind", "vid", "role"))


def _seen(spark, sf):
    return checkpointed(R.observable(V.samples(spark, sf), "seen"))


oracle.define("srec", ("records", "obs"), """
  select r.* from records r join obs x on x.vid = r.a and x.i = r.i and x.observable
    join obs y on y.vid = r.b and y.i = r.j and y.observable""")


@query("run12_merged_stretches", "srec", """
  , o as (select * from srec where a < b and unresolved),
  g as (select *, sum(case when p is null or i - p > 6 then 1 else 0 end) over (partition by a, b order by i, j
      rows unbounded preceding) as run from (select *, lag(i) over (partition by a, b order by i, j) as p from o)),
  m as (select g.image_id, g.a, g.b, run, min(g.i) as i0, max(g.i) as i1, min(g.j) as j0, max(g.j) as j1,
      median(coalesce(x.contrast, 0)) as pa, median(coalesce(y.contrast, 0)) as pb, median(x.r) as ra, median(y.r) as rb,
      median(x.st) as sa, median(y.st) as sb from g join obs x on x.vid = g.a and x.i = g.i
      join obs y on y.vid = g.b and y.i = g.j group by g.image_id, g.a, g.b, run)
  select image_id, a, b, i0, i1, j0, j1, case when row(pa, ra, -a) < row(pb, rb, -b) then a else b end as weaker,
    case when row(pa, ra, -a) < row(pb, rb, -b) then b else a end as stronger from m
  where greatest(sa, sb) <= 2 * least(sa, sb)""")
def run12(spark, sf):
    s = _seen(spark, sf)
    rec = checkpointed(J.pair_records(s.where("seen")).where("unresolved and a < b"))
    return V2.merge_stretches(rec, s)


@query("run13_extend_lines")
def run13(spark, sf):
    s = _seen(spark, sf)
    cl = R.owner_runs(R.share_out(_cores(s), E, ["jid"], "anchor", ["jid"]), E)
    out = V2.extend_lines(s.selectExpr(*E, "i", "seen as line", "in_frame"), cl)
    return out.groupBy(*E).agg(F.expr("count_if(line)").alias("n_line"), F.count(F.lit(1)).alias("n"))


@query("rul02_crossing_cores")
def rul02(spark, sf):
    s = _seen(spark, sf)
    res = checkpointed(R.record_runs(checkpointed(J.pair_records(s.where("seen"))).where("unresolved")))
    return V2.crossing_cores(J.crossings(s), s, res)


@query("rul03_touching_events")
def rul03(spark, sf):
    s = _seen(spark, sf)
    res = checkpointed(R.record_runs(checkpointed(J.pair_records(s.where("seen"))).where("unresolved")))
    x = checkpointed(J.crossings(s))
    return V2.touching_cores(res, s, checkpointed(V2.crossing_cores(x, s, res)), x)


def _core_events(s):
    return _cores(s).selectExpr("cast(jid as string) as ev", "image_id", "'core' as kind", "cx as x", "cy as y", "vid", "lo",
                                "hi", "anchor")


@query("itr09_cluster_events")
def itr09(spark, sf):
    s = V.samples(spark, sf)
    return V2.cluster_events(checkpointed(_core_events(s)), s).selectExpr("image_id", "ev", "cluster",
                                                                          "round(extent, 6) as extent")


@query("itr10_join_overlapping_claims")
def itr10(spark, sf):
    """Junctions whose claims overlap by half the shorter one are joined while all their centres stay within 2 lambda."""
    c = checkpointed(_cores(V.samples(spark, sf)).selectExpr(*E, "jid", "lo", "hi", "cx as x", "cy as y"))
    over = J.overlapping_pairs(c.select(*E, "jid", "lo", "hi"), E, "jid", T.CORE_JOIN).selectExpr(
        "image_id", "least(a_jid, b_jid) as a", "greatest(a_jid, b_jid) as b").distinct()
    p = J.grid_join(J.tag(c.select("image_id", "jid", "x", "y"), "a"), J.tag(c.select("image_id", "jid", "x", "y"), "b"),
                    T.JOIN_DIAM_PX, f"a_jid < b_jid and sqrt({J.D2}) <= {T.JOIN_DIAM_PX}D")
    fits = checkpointed(p.selectExpr("image_id", "a_jid as a", "b_jid as b", f"sqrt({J.D2}) as d"))
    return U.linkage(c.selectExpr("image_id", "jid as id"), over.join(fits, ["image_id", "a", "b"]), fits)


@query("itr14_junctions")
def itr14(spark, sf):
    jn, _, _ = V2.junction_table(_seen(spark, sf), V.FRAME_W, V.FRAME_H)
    return jn


def _places(s):
    """Junctions for the line model: cells of 16 px whose cores lie on two edges or more, with their share of the claims."""
    c = checkpointed(_cores(s).withColumn("g", F.expr("struct(floor(cx / 16) as gx, floor(cy / 16) as gy)")))
    j = checkpointed(c.groupBy("image_id", "g").agg(F.min("jid").alias("jid"), F.count_distinct("vid").alias("n"), F.avg("cx").alias("x"),
                                                    F.avg("cy").alias("y")).where("n >= 2").drop("n"))
    cl = c.drop("jid").join(j.select("image_id", "g", "jid"), ["image_id", "g"])
    held = R.owner_runs(R.share_out(cl, E, ["jid"], "anchor", ["jid"]), E).selectExpr(*E, "owner.jid as jid", "lo", "hi")
    return j.drop("g"), checkpointed(held)


_AT_REST: dict = {}


def _settled(spark, sf):
    """The line model of all images at rest, with what it was made from. Solved once per application and folder: its tables are
    written to the shared folder, and the queries over it read them there."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _AT_REST:
        _AT_REST[key] = _solve(spark, sf)
    return _AT_REST[key]


def _solve(spark, sf):
    s = checkpointed(R.observable(V.samples(spark, sf), "obs").withColumn("prom", F.expr("coalesce(contrast, 0.0D)")))
    rec = J.pair_records(s.where("obs")).where("unresolved").selectExpr(
        "image_id", "least(a, b) as a", "greatest(a, b) as b", "case when a < b then i else j end as i", "case when a < b then j else i end as j")
    centres, claims = _places(s)
    st, active = L.line_fixpoint(s, rec, claims, centres)
    return s, st, active, centres


@query("itr11_line_fixpoint")
def itr11(spark, sf):
    """Edges of the line model once every junction has three lines or more and no stub is left."""
    _, st, _, _ = _settled(spark, sf)
    r = st.runs.select(*E, "run", "start_cause", "end_cause")
    return st.edges.join(r, [*E, "run"]).selectExpr(*E, "run", "i0", "i1", "u", "w", "p0", "p1", "linked", "start_cause", "end_cause")


def _graph(spark, sf):
    """The image graph. Two edges with successive numbers start at one network node, three end at one."""
    s, st, active, centres = _settled(spark, sf)
    n = s.groupBy(*E).agg(F.min_by(F.struct("x", "y"), "i").alias("p"), F.max_by(F.struct("x", "y"), "i").alias("q"))
    e = n.selectExpr(*E, "stack(2, 'start', vid div 2, p, 'end', 1000000000 + vid div 3, q) as (side, nid, p)")
    at = e.groupBy("image_id", "nid").agg(F.avg("p.x").alias("x"), F.avg("p.y").alias("y"))
    return st, *G.image_graph(st, active, centres, e.drop("p").join(at, ["image_id", "nid"]))


@query("itr15_observable_truth")
def itr15(spark, sf):
    """The image graph edge by edge: what it joins, which edges it carries, and the run it belongs to."""
    _, nodes, edges, ends = _graph(spark, sf)
    out = edges
    for side in ("source", "target"):
        out = out.join(nodes.selectExpr("image_id", f"node as {side}", f"kind as {side}_kind", f"degree as {side}_degree"), ["image_id", side])
    lab = ends.groupBy(*E, "run").agg(*[F.max(F.expr(f"case when side = '{x}' then label end")).alias(f"run_{x}") for x in ("start", "end")])
    return out.join(lab, [*E, "run"]).selectExpr(
        *E, "edge", "i0", "i1", "source", "source_kind", "source_degree", "target", "target_kind", "target_degree", "linked",
        "array_join(vids, ',') as vids", "run_start", "run_end")


@query("itr15_totals")
def itr15_totals(spark, sf):
    """Lengths per image, and its merged stretches."""
    st = _settled(spark, sf)[1]
    m = G.merged_stretches(st).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_merged"))
    return G.totals(st).join(m, "image_id", "left").na.fill(0, ["n_merged"])


@query("val04_graph_checks")
def val04_graph(spark, sf):
    """All rules over the image graph, with their number of breaches per image; a sound one has none."""
    st, nodes, edges, ends = _graph(spark, sf)
    bad = G.check(st, nodes, edges, ends, L.ARM_MIN_PX, T.MIN_RUN_PX).groupBy("image_id").agg(F.count(F.lit(1)).alias("problems"))
    return nodes.groupBy("image_id").agg(F.count(F.lit(1)).alias("nodes")).join(bad, "image_id", "left").na.fill(0, ["problems"])


# ------------------------------------------------------------------------------------------------ image graph
END = "coalesce(cast({j} as string), 'end:' || vid || ':' || {p} )"


@query("rul11_image_graph", "edges ends", """
  , n as (select u as jid, i0 as p, vid, 'start' as side from edges union all select w, i1, vid, 'end' from edges),
  k as (select case when jid is not null then 'j' || jid else side || vid || ':' || p end as node, count(*) as degree,
    max(case when jid is not null then 'J' else side end) as k, any_value(vid) as vid, any_value(p) as p from n group by 1)
  select node, degree, case when k = 'J' then case when degree >= 3 then 'junction' when degree = 2 then 'hidden_junction'
    else 'fade' end else case when e.at_border then 'border' when e.at_node then 'node' else 'fade' end end as kind
  from k left join ends e on e.vid = k.vid and e.i = k.p and e.side = k.k""")
def rul11(spark, sf):
    """Nodes of the image graph: junctions by their number of lines, free ends by what ends them."""
    s = checkpointed(R.observable(V.samples(spark, sf)))
    e = checkpointed(split_edges(s.where("observable"), core_owner(_cores(s))))
    n = e.selectExpr("image_id", "vid", "stack(2, u, i0, 'start', w, i1, 'end') as (jid, p, side)")
    n = n.withColumn("node", F.expr("case when jid is not null then concat('j', jid) else concat(side, vid, ':', p) end"))
    k = n.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.expr("bool_or(jid is not null)").alias("is_j"),
                              F.min(F.expr("case when jid is null then vid end")).alias("vid"),
                              F.min(F.expr("case when jid is null then p end")).alias("i"),
                              F.min(F.expr("case when jid is null then side end")).alias("side"))
    why = R.end_causes(s, "observable", 6, {"border": "not in_frame"}).select("vid", "i", "side", "cause")
    return k.join(why, ["vid", "i", "side"], "left").selectExpr("node", "degree", """
        case when is_j then case when degree >= 3 then 'junction' when degree = 2 then 'hidden_junction' else 'fade' end
             else coalesce(cause, 'fade') end as kind""")


@query("rul10_leaving_lines", "edges samples", """
  , l as (select vid, i0 as i, u as jid, 'out' as flow, 1 as sgn from edges where u is not null and not linked
    union all select vid, i1, w, 'in', -1 from edges where w is not null and not linked)
  select l.jid, l.vid, l.i, l.flow, round(any_value(a.tx) * any_value(sgn), 6) + 0 as dx, round(any_value(a.ty)
      * any_value(sgn), 6) + 0 as dy, any_value(2 * a.r) as width, any_value(a.st) as blur, round(median(s.cnr), 6) as cnr,
    round(median(s.contrast), 6) as contrast from l join samples a on a.vid = l.vid and a.i = l.i
  join samples s on s.vid = l.vid and (s.i - l.i) * l.sgn between 0 and 12 group by l.jid, l.vid, l.i, l.flow""")
def rul10(spark, sf):
    """Every line leaving a junction: direction, width, blur, medians of the first lambda."""
    s = checkpointed(R.observable(V.samples(spark, sf)))
    e = checkpointed(split_edges(s.where("observable"), core_owner(_cores(s))).where("not linked"))
    l = e.where("u is not null").selectExpr(*E, "i0 as i", "u as jid", "'out' as flow", "1 as sgn").unionByName(
        e.where("w is not null").selectExpr(*E, "i1 as i", "w as jid", "'in' as flow", "-1 as sgn"))
    at = l.join(s.select(*E, "i", "tx", "ty", "r", "st"), [*E, "i"])
    ids = ("jid", "vid", "i0", "flow")
    med = R.window_medians(l.withColumn("i0", F.col("i")), s.select(*E, "i", "cnr", "contrast"), 12,
                           {"cnr": "cnr", "contrast": "contrast"}, ids=ids).withColumnRenamed("i0", "i")
    return at.join(med, ["jid", "vid", "i", "flow"]).selectExpr(
        "jid", "vid", "i", "flow", "round(tx * sgn, 6) + 0 as dx", "round(ty * sgn, 6) + 0 as dy", "2 * r as width",
        "st as blur", "round(cnr, 6) as cnr", "round(contrast, 6) as contrast")


@query("rul12_dont_care_junctions", "obs_junctions traced_junctions", """
  select image_id, jid as id, 'hidden' as source from obs_junctions where type = 4
  union all select t.image_id, tj, 'complete' from traced_junctions t where not exists (select 1 from obs_junctions o
    where o.image_id = t.image_id and o.type = t.type and power(o.x - t.x, 2) + power(o.y - t.y, 2) <= 11.9 * 11.9)""")
def rul12(spark, sf):
    """Hidden junctions, and junctions of the complete rules that no observable one of the same type matches."""
    o, t = V.obs_junctions(spark, sf), V.traced_junctions(spark, sf)
    hit = J.grid_join(J.tag(t.select("image_id", "tj", "x", "y", "type"), "a"),
                      J.tag(o.select("image_id", "x", "y", "type"), "b"), T.LAMBDA_PX,
                      f"a_type = b_type and {J.D2} <= {T.LAMBDA_PX}D * {T.LAMBDA_PX}D").selectExpr("a_tj as tj").distinct()
    return o.where("type = 4").selectExpr("image_id", "jid as id", "'hidden' as source").unionByName(
        t.join(hit, "tj", "left_anti").selectExpr("image_id", "tj as id", "'complete' as source"))


@query("val03_junction_checks", "limits", """
  , a as (select *, case when in_link is not null then lo else greatest(lo - (3 + 2 * (vid % 2)), in_lim, 0) end as i0,
    case when out_link is not null then hi else least(hi + 3 + 2 * (vid % 2), out_lim, last) end as o0 from limits)
  select 'arms at one sample' as problem, vid, cid, lo from a where i0 >= o0
  union all select 'arm inside another claim', a.vid, a.cid, a.lo from a join limits b on b.vid = a.vid and b.cid <> a.cid
    and a.o0 between b.lo and b.hi and a.o0 <> a.hi
  union all select 'broken link', a.vid, a.cid, a.lo from a where out_link is not null and not exists (select 1 from a b
    where b.vid = a.vid and b.lo = a.hi + 1 and b.in_link is not null)""")
def val03(spark, sf):
    from filigrane.plans.sequences import _owner_runs
    lim = R.claim_limits(_owner_runs(spark, sf), ["vid"], "last", "cid").selectExpr(
        "vid", "lo", "hi", "last", "owner.cid as cid", "in_lim", "in_link", "out_lim", "out_link")
    a = checkpointed(lim.selectExpr(
        "*", "case when in_link is not null then lo else greatest(lo - (3 + 2 * (vid % 2)), in_lim, 0L) end as i0",
        "case when out_link is not null then hi else least(hi + 3 + 2 * (vid % 2), out_lim, last) end as o0"))
    one = a.where("i0 >= o0").selectExpr("'arms at one sample' as problem", "vid", "cid", "lo")
    # claims of an edge are disjoint, so a point lies in at most one: met in its stretch of 64
    held = a.selectExpr("vid", "cid as oc", "lo as ol", "hi as oh", "explode(sequence(lo div 64, hi div 64)) as b")
    inside = a.withColumn("b", F.expr("o0 div 64")).join(held, ["vid", "b"]).where(
        "oc <> cid and o0 between ol and oh and o0 <> hi").selectExpr("'arm inside another claim' as problem", "vid", "cid",
                                                                      "lo")
    back = a.where("in_link is not null").selectExpr("vid", "lo - 1 as hi")
    broken = a.where("out_link is not null").join(back, ["vid", "hi"], "left_anti").selectExpr(
        "'broken link' as problem", "vid", "cid", "lo")
    return one.unionByName(inside).unionByName(broken)


@query("val04_observable_checks", "edges obs", """
  , d as (select jid, count(*) as n from (select u as jid from edges where u is not null union all select w from edges
    where w is not null) group by jid)
  select 'junction with less than three lines' as problem, jid as id from d where n < 3
  union all select 'short loop', vid from edges where u = w and i1 - i0 + 1 < 5.95
  union all select 'edges overlap', a.vid from edges a join edges b on b.vid = a.vid and not a.linked and not b.linked
    and a.i0 < b.i0 and b.i0 <= a.i1
  union all select 'line outside the frame', vid from obs where observable and not in_frame""")
def val04(spark, sf):
    """Rules of a sound observable truth, one query each, put together."""
    s = checkpointed(R.observable(V.samples(spark, sf)))
    e = checkpointed(split_edges(s.where("observable"), core_owner(_cores(s))))
    d = e.where("u is not null").selectExpr("u as jid").unionByName(e.where("w is not null").selectExpr("w as jid")).groupBy(
        "jid").agg(F.count(F.lit(1)).alias("n"))
    few = d.where("n < 3").selectExpr("'junction with less than three lines' as problem", "jid as id")
    loop = e.where("u = w and i1 - i0 + 1 < 5.95D").selectExpr("'short loop' as problem", "vid as id")
    n = R.neighbours(e.where("not linked").selectExpr(*E, "i0 as lo", "i1 as hi", "i0 as owner"), E)
    over = n.where("prev_hi >= lo").selectExpr("'edges overlap' as problem", "vid as id")
    out = s.where("observable and not in_frame").selectExpr("'line outside the frame' as problem", "vid as id")
    return few.unionByName(loop).unionByName(over).unionByName(out)
