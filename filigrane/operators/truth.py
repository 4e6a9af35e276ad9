"""From settled lines to the graph of an image: run ends meet at nodes, merged ends split the lines they join."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane.operators import network as N
from filigrane.operators import runs as R
from filigrane.operators.lines import BRIDGE, State
from filigrane.operators.scan import CHUNK, groups_by_break, with_stretch
from filigrane.session import checkpointed

E = list(R.EDGE)
I = "image_id"
#: Kinds of nodes of an image graph.
KINDS = ("junction", "hidden_junction", "merged", "fade", "border")


def run_ends(st: State) -> DataFrame:
    """Both ends of every run: image_id, key (of its own node), vid, run, side, i, cause, m_vid, m_i, jid."""
    e = st.runs.selectExpr(*E, "run", "stack(2, 'start', a, start_cause, start_into, 'end', b, end_cause, end_into) as (side, i, cause, into)")
    e = e.selectExpr(*E, "run", "side", "i", "cause", "into.vid as m_vid", "into.i as m_i", "concat_ws(':', 'E', vid, run, side) as key")
    return e.join(st.samples.selectExpr(*E, "i", "x", "y", "owner as jid"), [*E, "i"])


def merge_points(st: State, ends: DataFrame, active: DataFrame, bridge: int = BRIDGE) -> tuple[DataFrame, DataFrame]:
    """Where merged ends attach: (image_id, key, node) and the samples (image_id, vid, run, i0, m) at which edges are cut.

    To the junction that owns the sample they merge into; else to a place on the edge that sample lies on, places within two samples of each
    other being one, those at the edge's own ends its ends; else to the end of a run of that edge within `bridge` samples; else
    to none."""
    want = ends.where("cause = 'merged'").select(I, "key", F.col("m_vid").alias("vid"), F.col("m_i").alias("i"))
    want = checkpointed(want.join(st.samples.selectExpr(*E, "i", "owner", "line"), [*E, "i"]).join(
        active.selectExpr(I, "jid as owner", "true as _on"), [I, "owner"], "left"))
    junction = want.where("_on and line").selectExpr(I, "key", "concat('J:', owner) as node")
    rest = want.where("not coalesce(_on and line, false)").select(*E, "i", "key")
    # the edges over each stretch of 64 samples
    over = st.edges.where("not linked").withColumn("_b", F.explode(F.expr("sequence(i0 div 64, i1 div 64)")))
    on = checkpointed(rest.withColumn("_b", F.expr("i div 64")).join(over.select(*E, "_b", "run", "i0", "i1", "u", "w"), [*E, "_b"])
                      .where("i between i0 and i1").drop("_b"))
    spots = on.select(*E, "run", "i0", "i1", "u", "w", "i").distinct().withColumn("_ck", F.expr(f"i div {CHUNK}"))
    spots = groups_by_break(spots, [*E, "run", "i0", "i1", "u", "w"], ["i"], "_ck", {"_p": ("max", "i")}, "_p is null or i > _p + 2", name="_g")
    spots = checkpointed(spots.join(spots.groupBy(*E, "run", "i0", "_g").agg(F.min("i").alias("m")), [*E, "run", "i0", "_g"]))
    spots = spots.withColumn("node", F.expr(
        "case when m <= i0 + 1 then case when u is null then concat_ws(':', 'E', vid, run, 'start') else concat('J:', u) end "
        "when m >= i1 - 1 then case when w is null then concat_ws(':', 'E', vid, run, 'end') else concat('J:', w) end "
        "else concat_ws(':', 'M', vid, m) end"))
    split = on.select(*E, "i", "key").join(spots.select(*E, "i", "node"), [*E, "i"]).select(I, "key", "node")
    left = rest.join(on.select(I, "key"), [I, "key"], "left_anti")
    near = left.withColumn("j", F.explode(F.expr(f"sequence(i - {bridge}, i + {bridge})"))).join(
        ends.selectExpr(*E, "i as j", "key as node"), [*E, "j"]).where("node <> key").groupBy(I, "key").agg(
        F.expr("min_by(node, struct(abs(j - i), node))").alias("node"))
    cuts = spots.where("node like 'M:%'").select(*E, "run", "i0", "m", "node").distinct()
    return checkpointed(junction.unionByName(split).unionByName(near)), checkpointed(cuts)


def image_graph(st: State, active: DataFrame, centres: DataFrame, vessel_ends: DataFrame | None = None, bridge: int = BRIDGE):
    """(nodes, edges, ends): the image graph of settled lines.

    nodes: image_id, node, kind (KINDS), x, y, degree; edges: image_id, edge, vid, run, i0, i1, source, target, linked, vids (own and merged ones);
    ends: image_id, vid, run, side, i, cause, node, label, merged_with. vessel_ends (image_id, vid, side, nid, x, y) says which
    network node an edge starts and ends at: two or more run ends there share a hidden junction; without it every such end fades.

    Junctions are those of the line model. Where a line merges into another one, that one is cut, and the place is a junction
    from three lines on, a hidden junction with two. Ends that merge into each other stay nodes of their own. Labels of run ends are the kinds of their
    nodes; an end at its edge's own end that nothing shares fades."""
    ends = checkpointed(run_ends(st))
    first = ends.where("cause = 'junction'").selectExpr(I, "key", "concat('J:', jid) as node")
    hidden = None
    if vessel_ends is not None:
        at = ends.where("cause = 'node'").join(vessel_ends.selectExpr(*E, "side", "nid", "x as nx", "y as ny"), [*E, "side"])
        hidden = checkpointed(at.join(at.groupBy(I, "nid").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), [I, "nid"]))
        first = first.unionByName(hidden.selectExpr(I, "key", "concat('H:', nid) as node"))
    attach, cuts = merge_points(st, ends, active, bridge)
    # an end may attach to another end: follow to the last one; what runs in a circle stays by itself
    to_end = attach.where("node like 'E:%'")
    if not to_end.isEmpty():
        f = N.follow(to_end.selectExpr(f"struct({I}, key) as id", f"struct({I}, node as key) as target")).selectExpr(
            f"id.{I}", "id.key", "target.key as _to")
        fixed = first.unionByName(attach.where("node not like 'E:%'")).withColumnRenamed("key", "_to").withColumnRenamed("node", "_at")
        f = f.join(fixed, [I, "_to"], "left").selectExpr(I, "key", "coalesce(_at, _to) as node")
        attach = attach.where("node not like 'E:%'").unionByName(f)
    known = first.unionByName(attach)
    ends = checkpointed(ends.join(known, [I, "key"], "left").withColumn("node", F.coalesce("node", "key")))
    # cut edges
    cut = cuts.groupBy(*E, "run", "i0").agg(F.array_sort(F.collect_list(F.struct("m", "node"))).alias("cuts"))  # more than two samples apart on one edge
    e = st.edges.where("not stub").join(cut, [*E, "run", "i0"], "left").withColumn("_k", F.explode(F.expr("sequence(0, coalesce(size(cuts), 0))")))
    name = "case when {j} is null then concat_ws(':', 'E', vid, run, '{s}') else concat('J:', {j}) end"
    e = e.selectExpr(
        *E, "run", "linked", "case when _k = 0 then i0 else cuts[_k - 1].m end as i0",
        "case when _k < coalesce(size(cuts), 0) then cuts[_k].m else i1 end as i1",
        "case when _k = 0 then p0 else cuts[_k - 1].m end as p0", "case when _k < coalesce(size(cuts), 0) then cuts[_k].m else p1 end as p1",
        f"case when _k = 0 then {name.format(j='u', s='start')} else cuts[_k - 1].node end as source",
        f"case when _k < coalesce(size(cuts), 0) then cuts[_k].node else {name.format(j='w', s='end')} end as target")
    is_at = ends.select(I, "key", "node")
    for side in ("source", "target"):
        e = e.join(is_at.selectExpr(I, f"key as {side}", f"node as _{side}"), [I, side], "left").withColumn(
            side, F.coalesce(f"_{side}", side)).drop(f"_{side}")
    e = e.withColumn("edge", F.expr("concat_ws(':', vid, i0, case when linked then 'l' else 'e' end)"))
    e = checkpointed(e)
    # what is merged into an edge: samples strictly inside it
    sub = st.samples.where("m_vid is not null and obs and not absorbed").selectExpr(I, "vid as sub", "m_vid as vid", "m_i as i")
    over = e.where("not linked").withColumn("_b", F.explode(F.expr("sequence(i0 div 64, i1 div 64)"))).select(*E, "_b", "edge", "i0", "i1")
    carried = (sub.withColumn("_b", F.expr("i div 64")).join(over, [*E, "_b"]).where("(i > i0 and i < i1) or (i1 - i0 < 2 and i between i0 and i1)")
               .groupBy(I, "edge").agg(F.collect_set("sub").alias("_subs")))  # edges of an image that one edge hides
    e = checkpointed(e.join(carried, [I, "edge"], "left").withColumn("vids", F.expr(
        "array_sort(array_union(array(vid), coalesce(_subs, array())))")).drop("_subs"))
    deg = e.selectExpr(I, "source as node").unionByName(e.selectExpr(I, "target as node")).groupBy(I, "node").agg(F.count(F.lit(1)).alias("degree"))
    # nodes: where they are and what they are
    shared = ends.where("node <> key and node like 'E:%'").select(I, "node").distinct().withColumn("_met", F.lit(True))
    place = (ends.where("node = key").selectExpr(I, "node", "case when cause = 'node' then 'fade' else cause end as kind", "x", "y")
             .join(shared, [I, "node"], "left").withColumn("kind", F.expr("case when _met then 'merge' else kind end")).drop("_met"))
    place = place.unionByName(active.join(centres, [I, "jid"]).selectExpr(I, "concat('J:', jid) as node", "'junction' as kind", "x", "y"))
    place = place.unionByName(cuts.join(st.samples.selectExpr(*E, "i as m", "x", "y"), [*E, "m"]).selectExpr(I, "node", "'merge' as kind", "x", "y"))
    if hidden is not None:
        place = place.unionByName(hidden.selectExpr(I, "concat('H:', nid) as node", "'hidden_junction' as kind", "nx as x", "ny as y").distinct())
    nodes = checkpointed(place.join(deg, [I, "node"], "left").na.fill(0, ["degree"]).withColumn("kind", F.expr(
        "case when kind = 'merge' then case when degree >= 3 then 'junction' when degree = 2 then 'hidden_junction' else 'merged' end "
        "when kind = 'hidden_junction' and degree >= 3 then 'junction' else kind end")))
    ends = ends.join(nodes.selectExpr(I, "node", "kind as label"), [I, "node"], "left").selectExpr(
        *E, "run", "side", "i", "cause", "node", "label", "m_vid as merged_with")
    return nodes, e, checkpointed(ends)


def merged_stretches(st: State) -> DataFrame:
    """image_id, vid, lo, hi, into: stretches of an edge that lie in other lines, with the edge most of their samples lie in (the smallest
    of equals)."""
    s = st.samples.withColumn("_m", F.expr("m_vid is not null and obs and not absorbed"))
    s = checkpointed(with_stretch(s, E, "_m").where("_m"))
    votes = s.groupBy(*E, "_gap", "m_vid").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    return votes.groupBy(*E, "_gap").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.expr("max_by(m_vid, struct(n, -m_vid))").alias("into")).drop("_gap")


def totals(st: State) -> DataFrame:
    """Lengths per image in px: observable, in_frame, line, merged, absorbed, internal, unobserved_line, and the number of edges seen."""
    px = lambda c: F.expr(f"sum(case when {c} then ds else 0.0D end)")
    return st.samples.groupBy(I).agg(
        px("obs").alias("observable_px"), px("in_frame").alias("in_frame_px"), px("line").alias("line_px"),
        px("m_vid is not null and obs and not absorbed").alias("merged_px"), px("absorbed and obs").alias("absorbed_px"),
        px("inner is not null and obs").alias("internal_px"), px("line and not obs").alias("unobserved_line_px"),
        F.expr("count(distinct case when obs then vid end)").alias("n_vessels_observable"))


def check(st: State, nodes: DataFrame, edges: DataFrame, ends: DataFrame, arm_min: float, min_run: float) -> DataFrame:
    """image_id, problem, item: what is wrong with an image graph; no row when it is sound. Every rule is one join or aggregate."""
    def bad(df, problem, item):
        return df.selectExpr(I, f"'{problem}' as problem", f"cast({item} as string) as item")
    deg = edges.selectExpr(I, "edge", "source as node").unionByName(edges.selectExpr(I, "edge", "target as node"))
    count = deg.groupBy(I, "node").agg(F.count(F.lit(1)).alias("n"))
    n = nodes.join(count, [I, "node"], "left").na.fill(0, ["n"])
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    length = edges.join(st.samples.groupBy(*E).agg(F.first("ds").alias("ds")), E)
    runs = ends.join(nodes.select(I, "node", "kind"), [I, "node"], "left")
    order = R.neighbours(st.runs.selectExpr(*E, "a as lo", "b as hi", "run as owner"), E)
    lines = st.samples.where("line")
    flags = st.samples.groupBy(*E).agg(F.expr("sum(case when obs then ds else 0.0D end)").alias("px"), F.expr(
        "bool_or(line or m_vid is not null or inner is not null)").alias("held"))
    gone = with_stretch(st.samples.where("obs is not null"), E, "absorbed").where("absorbed").groupBy(*E, "_gap").agg(
        F.expr("(max(i) - min(i)) * max(ds)").alias("px"))
    parts = [
        bad(deg.join(nodes, [I, "node"], "left_anti"), "edge at a missing node", "edge"),
        bad(edges.where("i1 < i0 and not linked or p1 < p0"), "edge without a polyline", "edge"),
        bad(edges.where("not array_contains(vids, vid)"), "edge does not carry itself", "edge"),
        bad(length.where(f"source = target and (p1 - p0) * ds < {arm_min}D"), "short loop", "edge"),
        bad(n.where("n <> degree"), "stored degree differs", "node"),
        bad(n.where(f"kind not in ({kinds})"), "unknown kind of node", "node"),
        bad(n.where("kind = 'junction' and n < 3"), "junction with less than three lines", "node"),
        bad(n.where("kind = 'hidden_junction' and n <> 2"), "hidden junction without two lines", "node"),
        bad(n.where("kind in ('fade', 'border', 'merged') and n <> 1"), "free end without one line", "node"),
        bad(runs.where("kind is null"), "run end at a missing node", "concat_ws(':', vid, run, side)"),
        bad(runs.where("label <> kind"), "run end not labelled by its node", "concat_ws(':', vid, run, side)"),
        bad(runs.where(f"label not in ({kinds})"), "unknown label of a run end", "concat_ws(':', vid, run, side)"),
        bad(lines.where("not in_frame"), "line outside the frame", "concat_ws(':', vid, i)"),
        bad(order.where("prev_hi >= lo"), "runs overlap", "concat_ws(':', vid, lo)"),
        bad(flags.where(f"px >= {min_run}D and not held"), "seen edge on no line", "vid"),
        bad(gone.where(f"px >= {arm_min}D"), "long absorbed stretch", "concat_ws(':', vid, _gap)"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
