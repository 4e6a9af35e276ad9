"""Networks: degrees, integrity, components, levels, orders, flow. Iterations are rounds of joins over checkpointed
tables; a round stops when a count says nothing changed."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane import tables as T
from filigrane.operators.scorecard import top_by
from filigrane.session import checkpointed


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node with its in- and out-degree and its kind."""
    d = (edges.selectExpr("u as nid", "0 as i", "1 as o").unionByName(edges.selectExpr("v as nid", "1 as i", "0 as o"))
         .groupBy("nid").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree")))
    return (nodes.join(d, "nid", "left").na.fill(0, ["in_degree", "out_degree"])
            .withColumn("node_kind", F.expr("""
                case when in_degree = 0 then 'inlet' when out_degree = 0 then 'outlet'
                     when in_degree = 1 and out_degree >= 2 then 'fork'
                     when out_degree = 1 and in_degree >= 2 then 'confluence' else 'anastomosis' end""")))


def end_directions(edges: DataFrame) -> DataFrame:
    """Unit direction in which an edge leaves its node at end 0 (u) or 1 (v): along its first control leg that has a
    length. vid, end, node, r, dx, dy."""
    e = edges.withColumn("end", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "c", F.expr("case when end = 0 then ctrl else reverse(ctrl) end")).withColumn(
        "leg", F.expr("filter(slice(c, 2, size(c)), p -> sqrt(power(p.x - c[0].x, 2) + power(p.y - c[0].y, 2)) "
                      "> 1e-9)[0]"))
    return e.selectExpr(
        "scene_id", "vid", "end", "case when end = 0 then u else v end as node",
        "case when end = 0 then r_ctrl[0] else r_ctrl[size(r_ctrl) - 1] end as r",
        "coalesce((leg.x - c[0].x) / sqrt(power(leg.x - c[0].x, 2) + power(leg.y - c[0].y, 2)), 1.0D) as dx",
        "coalesce((leg.y - c[0].y) / sqrt(power(leg.x - c[0].x, 2) + power(leg.y - c[0].y, 2)), 0.0D) as dy")


def junction_reach(arms: DataFrame, gap: float = 0.5) -> DataFrame:
    """How far from a node the lumens meeting there may overlap. Only the two widest arms per direction can decide,
    so a crowded node is reduced to its distinct directions before pairs are made."""
    top = top_by(arms.select("node", "dx", "dy", "r", "vid", "end"), ["node", "dx", "dy"],
                 [F.col("r").desc(), F.col("vid"), F.col("end")], 2)
    a = top.selectExpr("node", "dx as adx", "dy as ady", "r as ar", "rank as ak")
    b = top.selectExpr("node", "dx as bdx", "dy as bdy", "r as br", "rank as bk")
    p = a.join(b, "node").where("struct(adx, ady, ak) < struct(bdx, bdy, bk)")
    ang = "acos(least(greatest(adx * bdx + ady * bdy, -1.0D), 1.0D))"
    p = p.withColumn("w", F.expr(f"ar + br + {gap}D")).withColumn("ang", F.expr(ang))
    return p.groupBy("node").agg(F.expr(
        "1.25D * max(case when ang < radians(150) then w / greatest(sin(ang), 0.25D) else w end) + 1").alias("reach"))


def connected_components(pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, comp: the smallest node of each component. pairs: src, dst (any direction). Alternates large-star and
    small-star steps (every node linked to its smallest neighbour); both are joins with a minimum per node, so a
    node with very many neighbours is only a skewed join key."""
    e = checkpointed(pairs.selectExpr("greatest(src, dst) as a", "least(src, dst) as b").where("a <> b").distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        n = (e.selectExpr("a as n", "b as m").unionByName(e.selectExpr("b as n", "a as m")) if large
             else e.selectExpr("a as n", "b as m"))
        low = n.groupBy("n").agg(F.min("m").alias("lo")).withColumn("lo", F.least("n", "lo"))
        j = n.join(low, "n")
        if large:
            return j.where("m > n").selectExpr("m as a", "lo as b").where("a <> b").distinct()
        return (j.selectExpr("m as a", "lo as b").unionByName(low.selectExpr("n as a", "lo as b"))
                .where("a <> b").distinct())

    last = None
    while True:  # every round links nodes to smaller ones, so it ends
        e = checkpointed(star(checkpointed(star(e, True)), False))
        stamp = tuple(e.selectExpr("count(1)", "bit_xor(xxhash64(a, b))", "sum(cast(hash(b, a) as long))").first())
        if stamp == last:
            break
        last = stamp
    comp = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))
    if nodes is None:
        roots = e.selectExpr("b as node").distinct().join(comp, "node", "left_anti").selectExpr("node", "node as comp")
        return comp.unionByName(roots)
    return nodes.join(comp, "node", "left").withColumn("comp", F.expr("coalesce(comp, node)"))


def levels(nodes: DataFrame, edges: DataFrame):
    """Peel sources off a directed graph: (nid, level) of the nodes peeled; nodes on cycles stay out."""
    left = checkpointed(nodes.select("nid").distinct())
    e = checkpointed(edges.select("u", "v").distinct())
    out, level = None, 0
    while True:
        src = checkpointed(left.join(e.selectExpr("v as nid"), "nid", "left_anti"))
        if src.isEmpty():
            break
        got = src.withColumn("level", F.lit(level).cast("long"))
        out = got if out is None else out.unionByName(got)
        left = checkpointed(left.join(src, "nid", "left_anti"))
        e = checkpointed(e.join(src.withColumnRenamed("nid", "u"), "u", "left_anti"))
        level += 1
    return out, left


def prune_dead_ends(nodes: DataFrame, edges: DataFrame, keep: str) -> DataFrame:
    """Remove, again and again, nodes of degree one that `keep` does not hold, with their edges."""
    n, e = checkpointed(nodes), checkpointed(edges)
    while True:
        deg = e.selectExpr("u as nid").unionByName(e.selectExpr("v as nid")).groupBy("nid").agg(
            F.count(F.lit(1)).alias("d"))
        dead = checkpointed(n.where(f"not ({keep})").join(deg.where("d = 1"), "nid").select("nid"))
        if dead.isEmpty():
            return e
        e = checkpointed(e.join(dead.withColumnRenamed("nid", "u"), "u", "left_anti")
                         .join(dead.withColumnRenamed("nid", "v"), "v", "left_anti"))


def follow(links: DataFrame) -> DataFrame:
    """(id, target) chains followed to their end by doubling; chains that run in a circle are dropped. One doubling
    per binary digit of the number of links reaches the end of any chain; what still points on is a circle."""
    t = checkpointed(links.select("id", "target"))
    for _ in range(max(1, t.count().bit_length())):
        nxt = checkpointed(t.join(t.selectExpr("id as target", "target as _n"), "target", "left")
                           .selectExpr("id", "coalesce(_n, target) as target", "_n is not null as _moved"))
        done = nxt.where("_moved").isEmpty()
        t = nxt.drop("_moved")
        if done:
            return t
    return t.join(t.selectExpr("id as target"), "target", "left_anti").select("id", "target")


def bottom_up(tree: DataFrame, leaf: str, aggs: dict, combine: str, value: str = "val") -> DataFrame:
    """Values of a forest from the leaves to the roots: a leaf gets `leaf`, a node gets `combine` over the aggregates
    of its children's values once all of them are known; the aggregates see every distinct value once, with the
    number `n` of children that have it. tree: nid, parent (and what the expressions use)."""
    t = checkpointed(tree)
    kids = t.where("parent is not null").groupBy(F.col("parent").alias("nid")).agg(F.count(F.lit(1)).alias("_need"))
    todo = checkpointed(t.join(kids, "nid", "left"))
    front = checkpointed(todo.where("_need is null").withColumn(value, F.expr(leaf)).drop("_need"))
    todo = checkpointed(todo.where("_need is not null"))
    out = front
    seen = front.select("parent", value)
    while not todo.isEmpty():
        have = (seen.where("parent is not null").groupBy(F.col("parent").alias("nid"), value)
                .agg(F.count(F.lit(1)).alias("n")).groupBy("nid")
                .agg(F.sum("n").alias("_have"), *[F.expr(e).alias(n) for n, e in aggs.items()]))
        ready = checkpointed(todo.join(have, "nid").where("_have = _need").withColumn(value, F.expr(combine))
                             .select(*t.columns, value))
        if ready.isEmpty():
            break
        out = out.unionByName(ready)
        # values whose parent is still waiting are all that later rounds need
        todo = checkpointed(todo.join(ready.select("nid"), "nid", "left_anti"))
        seen = checkpointed(seen.unionByName(ready.select("parent", value))
                            .join(todo.selectExpr("nid as parent"), "parent", "left_semi"))
    return out


def relax_pressure(nodes: DataFrame, edges: DataFrame, eps: float = 1e-13, rounds: int = 2000) -> DataFrame:
    """Pressures of the free nodes as conductance-weighted means of their neighbours, the boundary held; nodes that no
    held node reaches keep 0.5. Solved until no node differs from that mean by eps times the largest held pressure (both are
    pressures, so neither the size of the network nor the scale of g enters); raises when `rounds` do not get there. nodes: nid, pressure and scene_id, which no edge crosses; edges: u, v, g.

    Conjugate gradients with the diagonal as preconditioner, all scenes at once: a round is one join with the neighbours
    and two sums per scene (Chronopoulos and Gear's form). Every answer is checked against the edges themselves."""
    e = edges.where("u <> v").selectExpr("u as nid", "v as other", "g").unionByName(
        edges.where("u <> v").selectExpr("v as nid", "u as other", "g"))
    e = checkpointed(e.groupBy("nid", "other").agg(F.sum("g").alias("g")))
    x = checkpointed(nodes.selectExpr("nid", "scene_id", "pressure is not null as fixed", "coalesce(pressure, 0.5D) as p"))
    free = x.where("not fixed").select("nid")
    eps *= x.agg(F.expr("max(case when fixed then abs(p) end)")).first()[0] or 1.0
    inner = checkpointed(e.join(free, "nid", "left_semi").join(free.withColumnRenamed("nid", "other"), "other", "left_semi"))
    left, off = rounds, None
    while True:
        near = e.join(x.selectExpr("nid", "p", "fixed"), "nid").where("not fixed").join(
            x.selectExpr("nid as other", "p as po"), "other").groupBy("nid").agg(
            F.sum("g").alias("d"), F.expr("sum(g * (po - p))").alias("r"))
        t = checkpointed(near.join(x.select("nid", "scene_id"), "nid").selectExpr(
            "nid", "scene_id", "d", "r", "0.0D as up", "0.0D as dir", "0.0D as s", "0.0D as ga", "0.0D as al"))
        worst = t.agg(F.expr("max(abs(r) / d)")).first()[0]
        if worst is None or worst < eps:
            return x.select("nid", "fixed", "p")
        if left <= 0:
            raise RuntimeError(f"pressures are off by {worst} after {rounds} rounds")
        while left > 0:
            left -= 1
            w = inner.join(t.selectExpr("nid as other", "r / d as zo"), "other").groupBy("nid").agg(
                F.expr("sum(g * zo)").alias("_w"))
            t = checkpointed(t.join(w, "nid", "left").withColumn("w", F.expr("r - coalesce(_w, 0.0D)")).drop("_w"))
            sums = checkpointed(t.groupBy("scene_id").agg(F.expr("sum(r * r / d)").alias("g1"), F.expr("sum(w * r / d)").alias("de"),
                                                          F.expr("max(abs(r) / d)").alias("off")))
            off = sums.agg(F.max("off")).first()[0]
            if off < eps / 4:
                break
            c = sums.withColumn("on", F.expr(f"off >= {eps / 4}D"))
            t = (t.join(c, "scene_id").withColumn("be", F.expr("coalesce(try_divide(g1, ga), 0.0D)"))
                 .withColumn("a1", F.expr("case when on then coalesce(try_divide(g1, de - coalesce(try_divide(be * g1, al), 0.0D)), "
                                          "0.0D) else 0.0D end"))
                 .withColumn("dir", F.expr("r / d + be * dir")).withColumn("s", F.expr("w + be * s"))
                 .selectExpr("nid", "scene_id", "d", "r - a1 * s as r", "up + a1 * dir as up", "dir", "s", "g1 as ga", "a1 as al"))
        x = checkpointed(x.join(t.select("nid", "up"), "nid", "left").selectExpr(
            "nid", "scene_id", "fixed", "p + coalesce(up, 0.0D) as p"))


def orient(edges: DataFrame, pressure: DataFrame) -> DataFrame:
    """Flow g (P_u - P_v) of every edge, turned downstream; drops below 1e-10, which is what solved pressures are good for,
    are ties: they go by node number and carry no flow."""
    pu = pressure.selectExpr("nid as u", "p as pu")
    pv = pressure.selectExpr("nid as v", "p as pv")
    d = edges.join(pu, "u").join(pv, "v").withColumn("dp", F.expr("pu - pv"))
    d = d.withColumn("back", F.expr("case when abs(dp) > 1e-10D then dp < 0 else u > v end"))
    return d.selectExpr("vid", "scene_id", "case when back then v else u end as u", "case when back then u else v end as v",
                        "case when abs(dp) > 1e-10D then abs(g * dp) else 0.0D end as flow", "back")


def shortest(edges: DataFrame, sources: DataFrame, limit: float) -> DataFrame:
    """Shortest distance of every node reached within `limit` from its nearest source, with the node before it."""
    best = checkpointed(sources.selectExpr("nid", "0.0D as dist", "cast(null as long) as pred"))
    front = best
    e = checkpointed(edges.groupBy("u", "v").agg(F.min("length").alias("length")))
    while True:
        step = (front.selectExpr("nid as u", "dist").join(e, "u").selectExpr("v as nid", "dist + length as nd", "u")
                .where(f"nd <= {limit}D").groupBy("nid").agg(F.expr("min(struct(nd, u))").alias("m")))
        better = step.join(best, "nid", "left").where("dist is null or m.nd < dist").selectExpr(
            "nid", "m.nd as dist", "m.u as pred")
        front = checkpointed(better)
        if front.isEmpty():
            return best
        best = checkpointed(best.join(front.select("nid"), "nid", "left_anti").unionByName(front))


def problems(nodes: DataFrame, edges: DataFrame, domain=None) -> DataFrame:
    """Rows (problem, id) of a network that is not sound; empty when it is."""
    n = nodes.select("nid", "x", "y", "depth")
    # every rule reads the edges: once written with what the rules need
    edges = checkpointed(edges.selectExpr("vid", "u", "v", "cls", "array(ctrl[0], ctrl[size(ctrl) - 1]) as ctrl",
                                          "array(z_ctrl[0], z_ctrl[size(z_ctrl) - 1]) as z_ctrl", "array_min(r_ctrl) as r_min", "array_min(z_ctrl) as z_min"))
    ends = (edges.selectExpr("vid", "u as nid", "ctrl[0] as p", "z_ctrl[0] as z")
            .unionByName(edges.selectExpr("vid", "v as nid", "ctrl[size(ctrl) - 1] as p", "z_ctrl[size(z_ctrl) - 1] as z"))
            .join(n, "nid", "left"))
    deg = checkpointed(degrees(nodes, edges))
    names = ", ".join(f"'{c}'" for c in T.CLASSES)
    out = [ends.where("x is null").selectExpr("'node missing' as problem", "vid as id"),
           ends.where("x is not null and sqrt(power(p.x - x, 2) + power(p.y - y, 2)) > 1e-6")
           .selectExpr("'end not on node'", "vid"),
           ends.where("x is not null and abs(z - depth) > 0.05D").selectExpr("'depth at end differs'", "vid"),
           edges.where("r_min <= 0").selectExpr("'radius not positive'", "vid"),
           edges.where("z_min < -1e-6").selectExpr("'negative depth'", "vid"),
           edges.where(f"cls not in ({names})").selectExpr("'unknown class'", "vid"),
           deg.where("in_degree + out_degree = 0").selectExpr("'isolated'", "nid"),
           deg.where("in_degree = 1 and out_degree = 1").selectExpr("'one in and one out'", "nid")]
    if domain is not None:
        x0, y0, x1, y1 = domain
        out.append(deg.where(f"node_kind in ('inlet', 'outlet') and least(x - {x0}, {x1} - x, y - {y0}, {y1} - y) > 1")
                   .selectExpr("'free end inside the domain'", "nid"))
    res = out[0]
    for o in out[1:]:
        res = res.union(o)
    return res
