"""Skeletons as networks: branches between nodes, nodes merged over short branches, and paths that go straight on through
nodes and crossings. Skeleton tables are (image_id, pid, y, x), one row per pixel, pid unique over all images.

A branch is a chain of half-edges: a step from a pixel to a linked one, numbered pixel * 8 + direction. At a pixel with two
links every half-edge has one successor, so chains are ordered by pointer doubling, both ways at once.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane.operators.network import connected_components
from filigrane.operators.paths import arclength
from filigrane.operators.raster import RING, label, skeleton_links
from filigrane.operators.rules import chain_positions, greedy_pairs
from filigrane.session import checkpointed

_DIR = "case " + " ".join(f"when dy = {dy} and dx = {dx} then {k}" for k, (dy, dx) in enumerate(RING)) + " end"


def trace(sk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Branches and their points.

    branches: image_id, bid, a, b, length; a and b are the nodes at side 0 and 1: the smallest pixel of a cluster of pixels
    with three or more links, or minus one minus the pixel of a free end; null for a ring, which is cut at its smallest pixel.
    points: image_id, bid, pos, y, x, arc, from side 0, the node pixels at both ends included. Lone pixels have no branch."""
    h = checkpointed(skeleton_links(sk).selectExpr("image_id", "src", "dst", f"cast({_DIR} as long) as k"))
    deg = checkpointed(h.groupBy(F.col("src").alias("pid")).agg(F.count(F.lit(1)).alias("deg")))
    ways = h.groupBy(F.col("src").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "dst")).alias("p"), F.max(F.struct("k", "dst")).alias("q")).where("n = 2")
    nxt = checkpointed(ways.selectExpr("d", "stack(2, p.dst * 8 + (p.k + 4) % 8, d * 8 + q.k, q.dst * 8 + (q.k + 4) % 8, d * 8 + p.k) "
                                            "as (id, next)"))
    chains = checkpointed(chain_positions(nxt.select("id", "next")))
    half = h.selectExpr("image_id", "src", "dst", "src * 8 + k as id", "dst * 8 + (k + 4) % 8 as back")
    rest = checkpointed(half.join(chains.select("id"), "id", "left_anti").join(deg.selectExpr("pid as src", "deg"), "src"))
    rings = rest.where("deg = 2").join(deg.selectExpr("pid as dst", "deg as deg2"), "dst").where("deg2 = 2")
    single = rest.join(rings.select("id"), "id", "left_anti").selectExpr("id", "id as start", "0L as pos")
    if not rings.isEmpty():
        cut = connected_components(rings.select("src", "dst")).where("node = comp").selectExpr("node as d")
        at = nxt.join(rings.select("id"), "id", "left_semi").join(cut, "d", "left_anti")
        chains = chains.unionByName(chain_positions(at.select("id", "next")))
    steps = checkpointed(chains.unionByName(single).join(half, "id"))
    ends = steps.groupBy("start").agg(F.expr("max_by(struct(back, dst), pos)").alias("z")).where("start < z.back")
    heads = steps.where("pos = 0").join(ends, "start").select("image_id", "start", "src", "z.dst")
    knots = checkpointed(label(sk.join(deg.where("deg >= 3").select("pid"), "pid", "left_semi").select("image_id", "pid", "y", "x"))
                         .selectExpr("pid", "comp as node")
                         .unionByName(deg.where("deg = 1").selectExpr("pid", "-1 - pid as node")))
    br = (heads.join(knots.selectExpr("pid as src", "node as a"), "src", "left")
          .join(knots.selectExpr("pid as dst", "node as b"), "dst", "left").withColumnRenamed("start", "bid"))
    # a single step inside a cluster is no branch
    br = br.join(single.selectExpr("id as bid", "true as lone"), "bid", "left").where("not (coalesce(lone, false) and a = b)")
    br = checkpointed(br.select("image_id", "bid", "a", "b", "src"))
    pix = (steps.selectExpr("start as bid", "pos + 1 as pos", "dst as pid").join(br.select("bid", "image_id"), "bid")
           .unionByName(br.selectExpr("bid", "0L as pos", "src as pid", "image_id")))
    pts = checkpointed(arclength(pix.join(sk.select("pid", "y", "x"), "pid").selectExpr(
        "image_id", "bid", "pos", "cast(y as double) as y", "cast(x as double) as x"), ["image_id", "bid"], "pos"))
    size = pts.groupBy("bid").agg(F.max("arc").alias("length"))
    return checkpointed(br.drop("src").join(size, "bid").select("image_id", "bid", "a", "b", "length")), pts


def arms(branches: DataFrame, points: DataFrame, lam: float, reach: float = 1.5) -> DataFrame:
    """Both ends of every branch: image_id, arm (bid * 2 + side), bid, node, py, px (the end pixel) and the unit direction
    (uy, ux) in which it leaves there, from a quarter of lambda, or 0.3 of a short branch, to `reach` lambda of arc. Where
    these two points coincide the direction is that of the whole branch, and null for a branch that returns to its start."""
    near, far = f"least({0.25 * lam!r}D, 0.3D * length)", f"least({reach * lam!r}D, length)"
    d = points.join(branches.select("bid", "length"), "bid")
    at = {"n0": near, "f0": far, "n1": f"length - {near}", "f1": f"length - {far}", "s": "0.0D", "e": "length"}
    p = "struct(arc, y, x)"
    got = d.groupBy("bid").agg(*[F.expr(f"max(case when arc <= {t} + 1e-9D then {p} end)").alias(f"{n}_lo") for n, t in at.items()],
                               *[F.expr(f"min(case when arc >= {t} - 1e-9D then {p} end)").alias(f"{n}_hi") for n, t in at.items()],
                               F.first("length").alias("length"))

    def on(n, c):
        lo, hi = f"{n}_lo", f"{n}_hi"
        return (f"case when {hi}.arc - {lo}.arc < 1e-9D then {lo}.{c} else {lo}.{c} + ({at[n]} - {lo}.arc) "
                f"/ ({hi}.arc - {lo}.arc) * ({hi}.{c} - {lo}.{c}) end")
    got = got.selectExpr("bid", *[f"{on(n, c)} as {n}{c}" for n in at for c in "yx"])
    sides = got.selectExpr("bid", "stack(2, 0, f0y - n0y, f0x - n0x, sy, sx, ey, ex, 1, f1y - n1y, f1x - n1x, ey, ex, sy, sx) "
                                  "as (side, vy, vx, py, px, oy, ox)")
    sides = sides.selectExpr("bid", "side", "py", "px", "explode(array(case when hypot(vy, vx) < 1e-6D then struct(oy - py as y, ox - px as x) "
                                                        "else struct(vy as y, vx as x) end)) as v").withColumn("n", F.expr("hypot(v.y, v.x)"))
    return (branches.select("image_id", "bid", "a", "b").join(sides, "bid").selectExpr(
        "image_id", "bid * 2 + side as arm", "bid", "case when side = 0 then a else b end as node", "py", "px",
        "case when n > 1e-6D then v.y / n end as uy", "case when n > 1e-6D then v.x / n end as ux"))


def merge_nodes(branches: DataFrame, longest: float) -> DataFrame:
    """node, merged: junctions joined by branches of at most `longest` become one, named by the smallest of them. Every
    junction has a row; free ends (negative) merge with nothing."""
    junctions = branches.selectExpr("explode(array(a, b)) as node").where("node >= 0").distinct()
    short = branches.where(f"a >= 0 and b >= 0 and a <> b and length <= {longest!r}D").selectExpr("a as src", "b as dst")
    return checkpointed(connected_components(short, junctions).withColumnRenamed("comp", "merged"))


def attach(branches: DataFrame, arms_: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Branches with their merged ends (ra, rb; null at a free end or ring), and the arms of the merged nodes: the ends of
    all branches that do not return to the node they come from."""
    b = checkpointed(branches.join(merged.selectExpr("node as a", "merged as ra"), "a", "left")
                     .join(merged.selectExpr("node as b", "merged as rb"), "b", "left"))
    outer = b.where("ra is null or rb is null or ra <> rb").select("bid")
    return b, checkpointed(arms_.join(outer, "bid", "left_semi").join(merged, "node").drop("node").withColumnRenamed("merged", "node"))


def straight_pairs(at: DataFrame, other: DataFrame, lam: float, turn_max: float, on: list[str], where: str = "true") -> DataFrame:
    """Pairs (a_, b_) of arms of which one goes on as the other: a turn of at most turn_max degrees, and the second end
    nearly on the line of the first. Adds turn."""
    a = at.select(*on, *[F.col(c).alias(f"a_{c}") for c in at.columns if c not in on])
    b = other.select(*on, *[F.col(c).alias(f"b_{c}") for c in other.columns if c not in on])
    off = "abs((b_py - a_py) * a_ux - (b_px - a_px) * a_uy)"
    return (a.join(b, on).where(where).withColumn("_c", F.expr("-(a_uy * b_uy + a_ux * b_ux)"))
            .where(f"_c >= cos(radians({turn_max!r}D)) and {off} <= {0.5 * lam!r}D + 0.25D * hypot(b_py - a_py, b_px - a_px)")
            .withColumn("turn", F.expr("degrees(acos(least(1.0D, _c)))")).drop("_c"))


def shallow_crossings(b: DataFrame, at: DataFrame, lam: float, turn_max: float, merge: float, xmerge: float) -> DataFrame:
    """node, other: merged nodes to make one because two paths share the branch between them: it is longer than `merge` and at
    most `xmerge` lambda, each of its nodes has two further arms, and these go on straight across it, one to one. In order of
    the branches, every node once."""
    mid = b.where(f"ra <> rb and length > {merge * lam!r}D and length <= {xmerge * lam!r}D").selectExpr("bid as mid", "ra", "rb", "image_id as img")
    full = at.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n = 3")
    mid = checkpointed(mid.join(full.selectExpr("node as ra"), "ra", "left_semi").join(full.selectExpr("node as rb"), "rb", "left_semi"))
    side = [mid.join(at.withColumnRenamed("node", n), n).where("bid <> mid").select("mid", "arm", "py", "px", "uy", "ux") for n in ("ra", "rb")]
    p = straight_pairs(side[0], side[1], lam, turn_max, ["mid"])
    # two arms on each side: they can be matched one to one when two straight pairs share no arm
    p = p.select("mid", "a_arm", "b_arm")
    q = p.selectExpr("mid", "a_arm as c_arm", "b_arm as d_arm")
    good = p.join(q, "mid").where("a_arm < c_arm and b_arm <> d_arm").select("mid").distinct()
    return greedy_pairs(mid.join(good, "mid", "left_semi").selectExpr("img", "ra as a", "rb as b", "mid"), "mid", ["img"]).selectExpr(
        "greatest(a, b) as node", "least(a, b) as other")


def continuation_paths(sk: DataFrame, lam: float, turn_max: float = 30.0, merge: float = 1.0, xmerge: float = 3.0,
                       reach: float = 1.5) -> dict[str, DataFrame]:
    """Paths of a skeleton that go on through junctions and crossings.

    Junctions joined by branches of up to `merge` lambda become one node, as do the two ends of a stretch that two paths
    share. At every node arms are paired straightest first, each once, up to turn_max. Tables:

    - members: image_id, path, pos, bid, flipped: the branches of each path in order; a path is named by its smallest branch and runs
      from the end whose first branch has the smaller number.
    - paths: image_id, path, n_branches, length (pixels, with the jumps across nodes), closed.
    - nodes: image_id, node, n_arms, n_pairs.
    - crossings: image_id, node, y, x, angle: every two pairs of a node with three or more arms.

    A node with arms and fewer than two pairs is a branch point if it has three arms or more. Branches inside a merged node are
    no part of a path. Pairs of arms are made per node, so work grows with the square of the arms of one node. An empty
    skeleton gives empty tables."""
    br, pts = trace(sk)
    ends = checkpointed(arms(br, pts, lam, reach))
    merged = merge_nodes(br, merge * lam)
    b, at = attach(br, ends, merged)
    more = checkpointed(shallow_crossings(b, at, lam, turn_max, merge, xmerge))
    if not more.isEmpty():
        merged = checkpointed(merged.join(more.withColumnRenamed("node", "merged"), "merged", "left")
                              .selectExpr("node", "coalesce(other, merged) as merged"))
        b, at = attach(br, ends, merged)
    pairs = checkpointed(straight_pairs(at, at, lam, turn_max, ["node"], "a_arm < b_arm")
                         .selectExpr("node", "a_arm as a", "b_arm as b", "turn"))
    pairs = checkpointed(greedy_pairs(pairs, "turn", ["node"]))
    arm = at.select("arm", "image_id", "py", "px", "uy", "ux")
    both = checkpointed(pairs.join(arm.selectExpr("arm as a", "image_id", "py as ay", "px as ax", "uy as auy", "ux as aux"), "a")
                        .join(arm.selectExpr("arm as b", "py as b_y", "px as b_x", "uy as buy", "ux as bux"), "b")
                        .selectExpr("image_id", "node", "a", "b", "hypot(ay - b_y, ax - b_x) as jump", "ay + b_y as sy", "ax + b_x as sx",
                                    "atan2(auy - buy, aux - bux) as ang"))
    nodes = checkpointed(at.groupBy("image_id", "node").agg(F.count(F.lit(1)).alias("n_arms"))
                         .join(both.groupBy("node").agg(F.count(F.lit(1)).alias("n_pairs")), "node", "left").na.fill(0, ["n_pairs"])
                         .select("image_id", "node", "n_arms", "n_pairs"))
    line = both.join(nodes.where("n_arms >= 3").select("node"), "node", "left_semi")
    cross = (line.select("image_id", "node", "a", "sy", "sx", "ang").join(
        line.selectExpr("node", "a as c", "sy as ty", "sx as tx", "ang as bng"), "node").where("a < c")
        .withColumn("d", F.expr("pmod(abs(ang - bng), pi())"))
        .selectExpr("image_id", "node", "(sy + ty) / 4 as y", "(sx + tx) / 4 as x", "degrees(least(d, pi() - d)) as angle"))
    outer = checkpointed(b.where("ra is null or rb is null or ra <> rb").select("image_id", "bid", "length"))
    link = both.selectExpr("shiftright(a, 1) as src", "shiftright(b, 1) as dst", "a", "b", "jump")
    comp = checkpointed(connected_components(link.select("src", "dst"), outer.selectExpr("bid as node")).selectExpr("node as bid", "comp as path"))
    of = link.join(comp.withColumnRenamed("bid", "src"), "src")
    size = comp.groupBy("path").agg(F.count(F.lit(1)).alias("n_branches"))
    tied = of.groupBy("path").agg(F.count(F.lit(1)).alias("n_links"))
    ring = checkpointed(size.join(tied, "path").where("n_links = n_branches").select("path"))
    # a circle is opened before side 0 of its smallest branch
    kept = checkpointed(of.join(ring.selectExpr("path", "path * 2 as gone"), "path", "left")
                        .where("gone is null or (a <> gone and b <> gone)").select("path", "a", "b", "jump"))
    go = kept.selectExpr("stack(2, a ^ 1L, b, b ^ 1L, a) as (id, next)")
    pos = chain_positions(go)
    alone = outer.selectExpr("bid * 2 as id").join(pos.select("id"), "id", "left_anti").selectExpr("id", "id as start", "0L as pos")
    pos = checkpointed(pos.unionByName(alone).selectExpr("shiftright(id, 1) as bid", "id", "start", "pos").join(comp, "bid"))
    first = pos.groupBy("path").agg(F.min("start").alias("start"))
    members = checkpointed(pos.join(first, ["path", "start"]).join(outer.select("bid", "image_id"), "bid")
                           .selectExpr("image_id", "path", "pos", "bid", "(id & 1L) = 1 as flipped"))
    span = (comp.join(outer, "bid").groupBy("image_id", "path").agg(F.count(F.lit(1)).alias("n_branches"), F.sum("length").alias("run"))
            .join(kept.groupBy("path").agg(F.sum("jump").alias("over")), "path", "left")
            .join(ring.selectExpr("path", "true as closed"), "path", "left"))
    return {"members": members, "nodes": nodes, "crossings": checkpointed(cross),
            "paths": checkpointed(span.selectExpr("image_id", "path", "n_branches", "run + coalesce(over, 0.0D) as length",
                                                  "coalesce(closed, false) as closed"))}
