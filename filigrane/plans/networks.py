"""Queries over networks: degrees, integrity, components, levels, orders, flow."""
from __future__ import annotations

from pyspark.sql import functions as F

from filigrane.functions import columns as C
from filigrane.operators import network as N
from filigrane.operators.quantile import quantiles
from filigrane.operators.scorecard import spearman
from filigrane.plans import oracle
from filigrane.plans.registry import query
from filigrane.session import checkpointed
from filigrane.sources import views as V

oracle.define("degs", ("nodes", "vessels"), """
  select n.*, coalesce(i.d, 0) as in_degree, coalesce(o.d, 0) as out_degree from nodes n
  left join (select v as nid, count(*) as d from vessels group by v) i on i.nid = n.nid
  left join (select u as nid, count(*) as d from vessels group by u) o on o.nid = n.nid""")
KIND = """case when in_degree = 0 then 'inlet' when out_degree = 0 then 'outlet'
  when in_degree = 1 and out_degree >= 2 then 'fork' when out_degree = 1 and in_degree >= 2 then 'confluence'
  else 'anastomosis' end"""
oracle.define("kinds", ("degs",), f"select *, {KIND} as node_kind from degs")


def _deg(spark, sf):
    return N.degrees(V.nodes(spark, sf), V.vessels(spark, sf))


@query("agg01_degrees", "degs", "select scene_id, nid, in_degree, out_degree from degs")
def agg01(spark, sf):
    return _deg(spark, sf).select("scene_id", "nid", "in_degree", "out_degree")


@query("agg02_node_kinds", "kinds", """
  select scene_id, nid, node_kind, case when in_degree = 1 and out_degree >= 2 then 'bifurcation'
    when out_degree = 1 and in_degree >= 2 then 'confluence' when in_degree >= 2 and out_degree >= 2 then 'anastomosis'
    else 'node' end as junction_type from kinds""")
def agg02(spark, sf):
    return _deg(spark, sf).selectExpr("scene_id", "nid", "node_kind", """
      case when in_degree = 1 and out_degree >= 2 then 'bifurcation' when out_degree = 1 and in_degree >= 2
        then 'confluence' when in_degree >= 2 and out_degree >= 2 then 'anastomosis' else 'node' end as junction_type""")


@query("agg03_class_counts", "vessels", """
  select scene_id, cls, side, count(*) as n, round(sum(length), 6) as length,
    round(sum(case when length between 10 and 60 then length else 0 end) / (480.0 * 300.0), 9) as density
  from vessels group by grouping sets ((scene_id, cls), (scene_id, side), (scene_id))""")
def agg03(spark, sf):
    V.vessels(spark, sf).createOrReplaceTempView("_agg03_vessels")
    return spark.sql("""
      select scene_id, cls, side, count(*) as n, round(sum(length), 6) as length,
        round(sum(case when length between 10 and 60 then length else 0 end) / (480.0D * 300.0D), 9) as density
      from _agg03_vessels group by grouping sets ((scene_id, cls), (scene_id, side), (scene_id))""")


oracle.define("calibre", ("vessels",), """
  select v.*, q as mean_r from vessels v join (select l_orderkey as vid, avg(l_quantity) as q from lineitem
    group by l_orderkey) p on p.vid = v.vid""")


def _calibre(spark, sf):
    p = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("vid")).agg(F.avg("l_quantity").alias("mean_r"))
    return V.vessels(spark, sf).join(p, "vid")


@query("agg04_flow_checks", "calibre", """,
  r as (select cls, u % 72 as l, v % 72 as m, flow, mean_r, rank() over (partition by cls order by flow)
      + (count(*) over (partition by cls, flow) - 1) / 2.0 as ra,
      rank() over (partition by cls order by mean_r) + (count(*) over (partition by cls, mean_r) - 1) / 2.0 as rb
    from calibre)
  select cls, round(corr(ra, rb), 6) as rho, count(*) as n, round(avg((l < m)::int), 6) as flow_as_tree,
    count(*) filter (flow < 2000) as stagnant from r group by cls""")
def agg04(spark, sf):
    d = checkpointed(_calibre(spark, sf))
    rho = spearman(d, ["cls"], "flow", "mean_r")
    f = d.groupBy("cls").agg(F.expr("avg(cast(u % 72 < v % 72 as double))").alias("flow_as_tree"),
                             F.expr("count_if(flow < 2000)").alias("stagnant"))
    return rho.join(f, "cls").selectExpr("cls", "round(rho, 6) as rho", "n", "round(flow_as_tree, 6) as flow_as_tree",
                                         "stagnant")


@query("agg05_visual_cost", "samples", """
  select vid, round(avg(r) * (count(*) filter (in_frame) + 0.02 * (max(s_px) - count(*) filter (in_frame)))
    * exp(-median(cnr) / 80), 6) as cost from samples group by vid""")
def agg05(spark, sf):
    """What an edge is worth to the image: radius, length in the frame, fading with its median depth (here cnr)."""
    s = V.samples(spark, sf)
    a = s.groupBy("vid").agg(F.avg("r").alias("r"), F.expr("count_if(in_frame)").alias("lf"), F.max("s_px").alias("l"))
    m = quantiles(s, ["vid"], "cnr", {"z": 0.5})
    return a.join(m, "vid").selectExpr("vid", "round(r * (lf + 0.02D * (l - lf)) * exp(-z / 80), 6) as cost")


oracle.define("arms_at", ("with_ctrl",), """
  select vid, u as node, r_ctrl[1] as r, ctrl[1] as a, ctrl[2] as b, ctrl[3] as c, ctrl[4] as d, 0 as e from with_ctrl
  union all select vid, v, r_ctrl[3], ctrl[4], ctrl[3], ctrl[2], ctrl[1], 1 from with_ctrl""")
oracle.define("dirs", ("arms_at",), """
  select vid, e as "end", node, r, (q.x - a.x) / l as dx, (q.y - a.y) / l as dy from (
    select *, sqrt(power(q.x - a.x, 2) + power(q.y - a.y, 2)) as l from (
      select *, case when sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2)) > 1e-9 then b
        when sqrt(power(c.x - a.x, 2) + power(c.y - a.y, 2)) > 1e-9 then c else d end as q from arms_at))""")


@query("path11_end_directions", "dirs", """
  select vid, cast("end" as bigint) as "end", node, round(dx, 6) as dx, round(dy, 6) as dy from dirs""")
def path11(spark, sf):
    return N.end_directions(V.with_ctrl(spark, sf)).selectExpr(
        "vid", "cast(end as bigint) as end", "node", "round(dx, 6) as dx", "round(dy, 6) as dy")


@query("agg22_junction_reach", "dirs", """
  select a.node, round(1.25 * max(case when acos(least(greatest(a.dx * b.dx + a.dy * b.dy, -1.0), 1.0)) < radians(150)
    then (a.r + b.r + 0.5) / greatest(sin(acos(least(greatest(a.dx * b.dx + a.dy * b.dy, -1.0), 1.0))), 0.25)
    else a.r + b.r + 0.5 end) + 1, 8) as reach
  from dirs a join dirs b on a.node = b.node and (a.vid, a."end") < (b.vid, b."end") group by a.node""")
def agg22(spark, sf):
    return N.junction_reach(N.end_directions(V.with_ctrl(spark, sf))).selectExpr("node", "round(reach, 8) as reach")


@query("val01_integrity", "with_ctrl kinds", """
  select problem, id from (
    select 'unknown class' as problem, vid as id from with_ctrl where cls not in ('capillary', 'arteriole', 'venule',
      'episcleral_artery', 'episcleral_vein', 'anastomosis', 'perforator')
    union all select 'one in and one out', nid from kinds where in_degree = 1 and out_degree = 1
    union all select 'isolated', nid from kinds where in_degree + out_degree = 0
    union all select 'radius not positive', vid from with_ctrl where list_min(r_ctrl) <= 0
    union all select 'negative depth', vid from with_ctrl where list_min(z_ctrl) < -1e-6
    union all select 'free end inside the domain', nid from kinds where node_kind in ('inlet', 'outlet')
      and least(x, 479 - x, y, 299 - y) > 1)""")
def val01(spark, sf):
    return N.problems(V.nodes(spark, sf), V.with_ctrl(spark, sf), (0, 0, 479, 299)).select("problem", "id")


LEVELS = ["l0 as (select nid, 0::bigint as level from nodes n where layer = 0)"]
for _k in range(1, 9):
    LEVELS.append(f"l{_k} as (select n.nid, coalesce(max(p.level) + 1, 0) as level from nodes n left join vessels e "
                  f"on e.v = n.nid left join l{_k - 1} p on p.nid = e.u where n.layer = {_k} group by n.nid)")
LEVELS = ", ".join(LEVELS)
ALL_LEVELS = " union all ".join(f"select * from l{_k}" for _k in range(9))


@query("itr01_levels", "nodes vessels", f", {LEVELS} {ALL_LEVELS}")
def itr01(spark, sf):
    return N.levels(V.nodes(spark, sf), V.vessels(spark, sf))[0]


@query("val02_acyclic", "vessels", """
  select count(*) = 0 as acyclic, count(*) as n_left from vessels where u >= v""")
def val02(spark, sf):
    """No edges are left once sources have been peeled off."""
    _, left = N.levels(V.nodes(spark, sf), V.vessels(spark, sf))
    return left.agg(F.count(F.lit(1)).alias("n_left")).selectExpr("n_left = 0 as acyclic", "n_left")


@query("val05_murray", "vessels", """
  select u as node, round(abs(power(p, 3) - s) / power(p, 3), 6) as residual, n from (
    select v as node, max(r) as p from vessels group by v) i join (
    select u, sum(power(r, 3)) as s, count(*) as n from vessels group by u having count(*) >= 2) o on o.u = i.node""")
def val05(spark, sf):
    """Residual of r0^3 = sum ri^3 at every node with one side in and at least two edges out."""
    e = V.vessels(spark, sf)
    i = e.groupBy(F.col("v").alias("node")).agg(F.max("r").alias("p"))
    o = e.groupBy(F.col("u").alias("node")).agg(F.expr("sum(power(r, 3))").alias("s"), F.count(F.lit(1)).alias("n"))
    return i.join(o.where("n >= 2"), "node").selectExpr(
        "node", "round(abs(power(p, 3) - s) / power(p, 3), 6) as residual", "n")


@query("val06_dead_flow", "kinds vessels", """
  select 'no flow' as problem, vid as id from vessels join (select scene_id, max(flow) as m from vessels
    group by scene_id) t using (scene_id) where flow <= 0.01 * m
  union all select 'interior source', nid from kinds where in_degree = 0 and layer > 0
  union all select 'interior sink', nid from kinds where out_degree = 0 and layer < 8""")
def val06(spark, sf):
    e, d = V.vessels(spark, sf), _deg(spark, sf)
    top = e.groupBy("scene_id").agg(F.max("flow").alias("m"))
    return (e.join(top, "scene_id").where("flow <= 0.01D * m").selectExpr("'no flow' as problem", "vid as id")
            .union(d.where("in_degree = 0 and layer > 0").selectExpr("'interior source'", "nid"))
            .union(d.where("out_degree = 0 and layer < 8").selectExpr("'interior sink'", "nid")))


oracle.define("sk_edges", ("skeleton",), """
  select a.pid as src, b.pid as dst from skeleton a join skeleton b on a.image_id = b.image_id
    and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 and a.pid <> b.pid""")


def grid_neighbours(px, offsets):
    """(src, dst) pairs of pixels at the given offsets, by equality on the shifted position."""
    off = ", ".join(f"struct({dy}L as dy, {dx}L as dx)" for dy, dx in offsets)
    a = px.selectExpr("image_id", "y", "x", "pid as src", f"explode(array({off})) as o").selectExpr(
        "image_id", "y + o.dy as y", "x + o.dx as x", "src")
    return a.join(px.selectExpr("image_id", "y", "x", "pid as dst"), ["image_id", "y", "x"]).select("src", "dst")


HALF8 = ((0, 1), (1, -1), (1, 0), (1, 1))
HALF4 = ((0, 1), (1, 0))


@query("cc01_components", "sk_edges skeleton", """--recursive
  , r as (select pid as node, pid as root from skeleton union select e.dst, r.root from r join sk_edges e on e.src = r.node)
  select node, min(root) as comp from r group by node""")
def cc01(spark, sf):
    s = checkpointed(V.skeleton(spark, sf))
    return N.connected_components(grid_neighbours(s, HALF8), s.selectExpr("pid as node"))


@query("itr02_prune_dead_ends", "tree", "--recursive" + """
  , up as (select nid, parent from tree where layer = 7 and parent is not null
    union select t.nid, t.parent from tree t join up on up.parent = t.nid where t.parent is not null)
  select parent as u, nid as v from up""")
def itr02(spark, sf):
    """Branches of the forest that lead nowhere (to no node of the last layer) are cut back; roots and the last layer
    are kept."""
    t = V.tree(spark, sf)
    e = t.where("parent is not null").selectExpr("parent as u", "nid as v", "nid as vid")
    left = N.prune_dead_ends(t.selectExpr("nid", "layer"), e, "layer = 7 or layer = 0")
    return left.join(t.selectExpr("nid as v"), "v").select("u", "v")


@query("itr03_follow_chains", "tree", """,
  l0 as (select nid, parent as t from tree where parent is not null),
  """ + ", ".join(f"l{k + 1} as (select l{k}.nid, coalesce(p.parent, l{k}.t) as t from l{k} left join tree p on p.nid = "
                  f"l{k}.t)" for k in range(8)) + """
  select nid as id, t as target from l8""")
def itr03(spark, sf):
    t = V.tree(spark, sf).where("parent is not null").selectExpr("nid as id", "parent as target")
    return N.follow(t)


def _fold_sql(leaf, combine, out):
    parts = [f"f7 as (select nid, parent, {leaf} as val from tree where layer = 7)"]
    for k in range(6, -1, -1):
        parts.append(f"f{k} as (select t.nid, t.parent, case when count(c.nid) = 0 then {leaf} else {combine} end as val "
                     f"from tree t left join (select *, max(val) over (partition by parent) as mx from f{k + 1}) c "
                     f"on c.parent = t.nid where t.layer = {k} group by t.nid, t.parent, t.leaf_r)")
    return (", " + ", ".join(parts) + f" select nid, {out} from ("
            + " union all ".join(f"select nid, val from f{k}" for k in range(8)) + ")")


@query("itr04_strahler_order", "tree", _fold_sql(
    "1", "max(c.val) + case when count(*) filter (c.val = c.mx) >= 2 then 1 else 0 end", "cast(val as bigint) as ord"))
def itr04(spark, sf):
    return N.bottom_up(V.tree(spark, sf), "1L", {"top": "max(struct(val, n))"},
                       "top.val + case when top.n >= 2 then 1L else 0L end").selectExpr("nid", "val as ord")


@query("itr05_bottom_up_radius", "tree", _fold_sql(
    "least(leaf_r, 12.0)", "least(power(sum(power(c.val, 2.7)), 1 / 2.7), 12.0)", "round(val, 6) as radius"))
def itr05(spark, sf):
    """r0^2.7 = sum of ri^2.7 from the leaves up, at most 12."""
    return N.bottom_up(V.tree(spark, sf), "least(leaf_r, 12.0D)", {"s": "sum(n * power(val, 2.7D))"},
                       "least(power(s, 1 / 2.7D), 12.0D)").selectExpr("nid", "round(val, 6) as radius")


@query("itr07_conductance", "", """
  select l_orderkey as vid, round(1e6 / (count(*) * avg(1 / power(greatest(1 + l_quantity / 10, 1e-3), 4))), 6) as g
  from lineitem group by l_orderkey""")
def itr07(spark, sf):
    """1 / (L mean(r^-4)) per edge over its pieces, in millionths."""
    return V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("vid")).agg(F.expr(
        "round(1e6D / (count(1) * avg(1 / power(greatest(1 + l_quantity / 10, 1e-3D), 4))), 6)").alias("g"))


oracle.define("cond", ("vessels",), "select *, power(r, 4) / length as g from vessels")
# the SQL solves as well: relaxation of second order, in which an error shrinks by a fifth a round where plain means of
# the neighbours take off a fiftieth (the networks have eight layers between their held ends)
OVER, ROUNDS = 1.67, 240
oracle.define("solved", ("cond", "nodes"), f"""
  with recursive ed as materialized (select u as nid, v as other, g from cond union all select v, u, g from cond),
  it as (select 0 as k, nid, pressure is not null as fixed, coalesce(pressure, 0.5)::double as p, coalesce(pressure, 0.5)::double as prev from nodes
    union all select s.k + 1, s.nid, any_value(s.fixed), case when any_value(s.fixed) then any_value(s.p) else any_value(s.prev)
        + {OVER} * (coalesce(sum(e.g * o.p) / sum(e.g), any_value(s.p)) - any_value(s.prev)) end, any_value(s.p)
      from it s left join ed e on e.nid = s.nid left join it o on o.nid = e.other where s.k < {ROUNDS} group by s.k, s.nid)
  select nid, fixed, p from it where k = {ROUNDS}""")
oracle.define("flow", ("cond", "solved"), """
  select vid, scene_id, case when back then v else u end as u, case when back then u else v end as v,
    case when abs(dp) > 1e-10 then g * abs(dp) else 0 end as flow, back from (
    select c.*, a.p - b.p as dp, case when abs(a.p - b.p) > 1e-10 then a.p < b.p else c.u > c.v end as back
    from cond c join solved a on a.nid = c.u join solved b on b.nid = c.v)""")


def _flow(spark, sf):
    e = checkpointed(V.vessels(spark, sf).withColumn("g", F.expr("power(r, 4) / length")))
    p = checkpointed(N.relax_pressure(V.nodes(spark, sf), e))
    return p, checkpointed(N.orient(e, p))


@query("itr06_pressures", "solved", "select nid, fixed, round(p, 6) + 0 as p from solved")
def itr06(spark, sf):
    return _flow(spark, sf)[0].selectExpr("nid", "fixed", "round(p, 6) as p")


@query("itr06_flow", "flow", """
  select f.vid, u, v, round(flow, 6) as flow, back, flow < 0.001 * m as stagnant
  from flow f join (select scene_id, median(flow) as m from flow group by scene_id) t on t.scene_id = f.scene_id""")
def itr06_flow(spark, sf):
    """Flows at the solved pressures, edges turned downstream, those far below their scene's median marked."""
    _, f = _flow(spark, sf)
    m = quantiles(f, ["scene_id"], "flow", {"m": 0.5})
    return f.join(m, "scene_id").selectExpr("vid", "u", "v", "round(flow, 6) as flow", "back",
                                            "flow < 0.001D * m as stagnant")


SHORT = ["d0 as (select nid, 0.0::double as dist, null::bigint as pred from nodes where layer = 0)"]
for _k in range(1, 9):
    SHORT.append(f"d{_k} as (select v as nid, min(dist + length) as dist, arg_min(u, {{'d': dist + length, 'u': u}}) as "
                 f"pred from d{_k - 1} join vessels e on e.u = d{_k - 1}.nid where dist + length <= 150 group by v)")


@query("itr08_shortest_routes", "nodes vessels", ", " + ", ".join(SHORT) + " " + " union all ".join(
    f"select * from d{_k}" for _k in range(9)))
def itr08(spark, sf):
    """Shortest way from the first layer to every node, up to a length."""
    n = V.nodes(spark, sf)
    return N.shortest(V.vessels(spark, sf), n.where("layer = 0"), 150.0)


@query("src11_node_link_tables", "kinds vessels", """
  select 'node' as kind, nid as id, cast(null as bigint) as src, cast(null as bigint) as dst, node_kind as label
  from kinds union all select 'edge', vid, u, v, cls from vessels""")
def src11(spark, sf):
    n = _deg(spark, sf).selectExpr("'node' as kind", "nid as id", "cast(null as bigint) as src",
                                   "cast(null as bigint) as dst", "node_kind as label")
    return n.union(V.vessels(spark, sf).selectExpr("'edge'", "vid", "u", "v", "cls"))


@query("src12_typed_attributes", "tree", """
  select nid, coalesce(parent, -1) as parent, coalesce(case when layer > 3 then leaf_r end, 'nan'::double) as radius,
    coalesce(case when parent is null then 'root' end, '') as tag,
    '[' || layer || ', ' || scene_id || ']' as path from tree""")
def src12(spark, sf):
    """One type per attribute: missing integers -1, doubles NaN, strings empty, lists as text."""
    return V.tree(spark, sf).selectExpr(
        "nid", "coalesce(parent, -1) as parent", "coalesce(case when layer > 3 then leaf_r end, double('nan')) as radius",
        "coalesce(case when parent is null then 'root' end, '') as tag",
        "concat('[', array_join(transform(array(layer, scene_id), v -> cast(v as string)), ', '), ']') as path")


@query("prj17_reverse_edge", "with_ctrl", """
  select vid, v as u, u as v, ctrl[4].x as x0, ctrl[1].x as x1, r_ctrl[3] as r0,
    z_ctrl[3] as z0 from with_ctrl""")
def prj17(spark, sf):
    return V.with_ctrl(spark, sf).selectExpr(
        "vid", "v as u", "u as v", "reverse(ctrl) as c", "reverse(r_ctrl) as r", "reverse(z_ctrl) as z").selectExpr(
        "vid", "u", "v", "c[0].x as x0", "c[3].x as x1", "r[0] as r0", "z[0] as z0")


@query("prj03_bounding_boxes", "with_ctrl", """
  select vid, x0, x1, y0, y1 from (select vid, least(ctrl[1].x, ctrl[2].x, ctrl[3].x, ctrl[4].x) as x0,
      greatest(ctrl[1].x, ctrl[2].x, ctrl[3].x, ctrl[4].x) as x1, least(ctrl[1].y, ctrl[2].y, ctrl[3].y, ctrl[4].y) as y0,
      greatest(ctrl[1].y, ctrl[2].y, ctrl[3].y, ctrl[4].y) as y1 from with_ctrl)
  where x1 >= -48 and x0 <= 159 + 48 and y1 >= -48 and y0 <= 99 + 48""")
def prj03(spark, sf):
    """Edges whose control points come near the frame."""
    d = V.with_ctrl(spark, sf).selectExpr("vid", "transform(ctrl, p -> p.x) as xs", "transform(ctrl, p -> p.y) as ys")
    d = d.selectExpr("vid", "array_min(xs) as x0", "array_max(xs) as x1", "array_min(ys) as y0", "array_max(ys) as y1")
    return d.where("x1 >= -48 and x0 <= 159 + 48 and y1 >= -48 and y0 <= 99 + 48")


@query("fn10_bounds", "with_ctrl", """
  select scene_id, min(p.x) as x0, max(p.x) as x1, min(p.y) as y0, max(p.y) as y1 from (
    select scene_id, unnest(ctrl) as p from with_ctrl) group by scene_id""")
def fn10(spark, sf):
    return V.with_ctrl(spark, sf).selectExpr("scene_id", "explode(ctrl) as p").groupBy("scene_id").agg(
        F.min("p.x").alias("x0"), F.max("p.x").alias("x1"), F.min("p.y").alias("y0"), F.max("p.y").alias("y1"))


@query("fn12_mean_velocity", "calibre", "select vid, round(flow / (pi() * mean_r * mean_r), 6) as velocity from calibre")
def fn12(spark, sf):
    return _calibre(spark, sf).selectExpr("vid", "round(flow / (pi() * mean_r * mean_r), 6) as velocity")


FNS = {
    "angle": "case when dx = 0 and dy = 0 then 0.0 else " + C.angle_deg("dy", "dx") + " end",
    "between": C.angle_between_deg("tx", "ty", "0.6", "0.8"),
    "acute": C.acute_angle_deg("tx", "ty", "0.6", "0.8"),
    "off_line": C.line_offset("80.0", "50.0", "0.6", "0.8", "x", "y"),
    "resolution_gap": C.g_res("r", "1.5", "st", "1.25"),
    "step": C.smoothstep("cnr", "1.0", "20.0"),
    "log_cnr": C.log_floor("cnr"),
    "four_digits": C.significant("peak", 4),
    "blur": "sqrt(greatest((r + st) / 2, 0.0))",
    "margin": "cast(greatest(3, ceil((2 * st + 1) / ds)) as bigint)",
    "mean_ratio": "greatest(r, st, 0.0001) / greatest(least(r, st), 0.0001)",
}

@query("fn01_scalar_functions", "samples steps", """
  , t(x0, x1, y0, y1) as (values (0.0, 0.1, 2.73, 2.57), (0.1, 0.2, 2.57, 2.38), (0.2, 0.3, 2.38, 2.2), (0.3, 0.4, 2.2, 2.03),
    (0.4, 0.5, 2.03, 1.86), (0.5, 0.6, 1.86, 1.7), (0.6, 0.8, 1.7, 1.4), (0.8, 1.0, 1.4, 1.13), (1.0, 1.25, 1.13, 0.84),
    (1.25, 1.5, 0.84, 0.59), (1.5, 1.75, 0.59, 0.39), (1.75, 2.0, 0.39, 0.21), (2.0, 2.5, 0.21, 0.0)),
  b as (select *, sqrt((st * st + 1.5625) / 2) as spread from samples),
  u as (select *, least(r, 1.5) / greatest(spread, 1e-6) as rho, least(greatest((cnr - 1) / 19, 0), 1) as ramp,
    floor(log10(abs(peak)))::int as size from b)
  select s.vid, s.i, round(coalesce(degrees(atan2(nullif(p.dy, 0), p.dx)), case when p.dx < 0 then 180 else 0 end), 6) as angle,
    round(degrees(acos(greatest(least(s.tx * 0.6 + s.ty * 0.8, 1), -1))), 6) as between,
    round(degrees(acos(least(abs(s.tx * 0.6 + s.ty * 0.8), 1))), 6) as acute,
    round(abs(0.6 * (s.y - 50) - 0.8 * (s.x - 80)), 6) as off_line,
    round(s.spread * coalesce(t.y0::double + (s.rho - t.x0) * (t.y1 - t.y0)::double / (t.x1 - t.x0)::double, 0), 6) as resolution_gap,
    round(3 * power(s.ramp, 2) - 2 * power(s.ramp, 3), 6) as step, round(ln(greatest(s.cnr, 0.000001)), 6) as log_cnr,
    round(case when s.peak = 0 then 0 when s.size <= 3 then floor(s.peak * power(10, 3 - s.size) + 0.5) / power(10, 3 - s.size)
      else floor(s.peak / power(10, s.size - 3) + 0.5) * power(10, s.size - 3) end, 6) as four_digits,
    round(sqrt((s.r + s.st) / 2), 6) as blur, case when 2 * s.st + 1 > 3 * s.ds then ceil((2 * s.st + 1) / s.ds) else 3 end::bigint as margin,
    round(case when s.r > s.st then s.r / greatest(s.st, 0.0001) else s.st / greatest(s.r, 0.0001) end, 6) as mean_ratio
  from u s join steps p on p.event_id = s.event_id left join t on s.rho >= t.x0 and s.rho < t.x1""")
def fn01(spark, sf):
    """FN-01..04, 07, 09, 11 and PRJ-09 over every sample."""
    s = V.samples(spark, sf).withColumn("dx", F.expr("cast((37 * event_id) % 5 - 2 as bigint)")).withColumn(
        "dy", F.expr("cast((53 * event_id) % 5 - 2 as bigint)"))
    return s.selectExpr("vid", "i", *[(f"round({C.doubles(e)}, 6) as {n}" if n != "margin" else f"{e} as {n}")
                                      for n, e in FNS.items()])


@query("fn05_segment_intersection", "seg crossings", """
  select image_id, count(*) as n, round(sum(s_a - i), 6) as ta, round(sum(s_b - j), 6) as tb from crossings
  group by image_id""")
def fn05(spark, sf):
    """Parameters of the intersections along both segments, summed per image."""
    from filigrane.operators.relate import crossings
    c = crossings(V.samples(spark, sf))
    return c.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.expr("round(sum(s_a - i), 6)").alias("ta"),
                                     F.expr("round(sum(s_b - j), 6)").alias("tb"))


@query("fn08_names", "", """
  select n_nationkey, replace(replace(lower(n_name), '_', '-'), ' ', '-') || ':' || printf('%04d', n_nationkey) as key,
    '[' || n_nationkey || ';' || n_regionkey || ']' as list, nullif(n_regionkey, 0) as null_for_zero
  from nation""")
def fn08(spark, sf):
    return V.table(spark, sf, "nation").selectExpr(
        "n_nationkey", "concat(replace(replace(lower(n_name), '_', '-'), ' ', '-'), ':', "
        "format_string('%04d', n_nationkey)) as key",
        "concat('[', array_join(transform(array(n_nationkey, n_regionkey), v -> cast(v as string)), ';'), ']') as list",
        "nullif(n_regionkey, 0) as null_for_zero")
