"""Typing rules of junctions, pairing of arms, lineage."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane.session import checkpointed


def through_pairs(lines: DataFrame, cont: DataFrame) -> DataFrame:
    """jid of junctions with exactly four lines that pair up into two through lines: every line in with one line out of
    the same edge, or of a child of it (cont: jid, p, c). lines: jid, edge, vid, flow."""
    four = lines.groupBy("jid").agg(F.count(F.lit(1)).alias("n"), F.expr("count_if(flow = 'in')").alias("k")).where(
        "n = 4 and k = 2").select("jid")
    # four rows per junction are left
    l = lines.join(four, "jid")
    i, o = l.where("flow = 'in'"), l.where("flow = 'out'")
    p = i.selectExpr("jid", "edge as ie", "vid as iv").join(o.selectExpr("jid", "edge as oe", "vid as ov"), "jid")
    c = cont.selectExpr("jid", "p as iv", "c as ov", "true as kin").distinct()
    p = p.join(c, ["jid", "iv", "ov"], "left").withColumn("ok", F.expr("iv = ov or coalesce(kin, false)"))
    rank = p.groupBy("jid").agg(F.min("ie").alias("i0"), F.min("oe").alias("o0"))
    p = p.join(rank, "jid").withColumn("straight", F.expr("(ie = i0) = (oe = o0)"))
    return p.groupBy("jid").agg(F.expr("bool_and(ok) filter (where straight)").alias("s"),
                                F.expr("bool_and(ok) filter (where not straight)").alias("x")).where("s or x").select("jid")


def observable_type(lines: DataFrame, members: DataFrame) -> DataFrame:
    """Type of a junction from the lines that leave it. members: jid, kind, parents, children (arrays, NULL where the
    event is no node)."""
    n = lines.groupBy("jid").agg(F.count(F.lit(1)).alias("n_lines"))
    three = lines.join(n.where("n_lines = 3").select("jid"), "jid").groupBy("jid").agg(F.collect_set("vid").alias("vs"))
    t = three.where("size(vs) = 3").join(members.where("parents is not null"), "jid").where(
        "size(array_except(vs, array_union(parents, children))) = 0").selectExpr(
        "jid", "size(array_intersect(vs, parents)) as n_in").groupBy("jid").agg(F.min("n_in").alias("n_in"))
    cont = members.where("parents is not null").selectExpr("jid", "explode(parents) as p", "children").selectExpr(
        "jid", "p", "explode(children) as c")
    x = through_pairs(lines, cont).withColumn("through", F.lit(True))
    return n.join(t, "jid", "left").join(x, "jid", "left").selectExpr("jid", "n_lines", """
        case when n_lines <= 2 then 'none'
             when n_lines = 3 then case when n_in is null then 'pseudo-T' when n_in <= 1 then 'bifurcation'
                                        else 'confluence' end
             when n_lines = 4 and through then 'crossing' else 'compound' end as type_observable""")


def visible_type(lines: DataFrame, events: DataFrame) -> DataFrame:
    """What an observer calls a junction. lines: jid, line, vid (the edges of every seen line); events: jid, ev, kind,
    type, vessels."""
    per_line = lines.distinct().groupBy("jid", "line").agg(F.count(F.lit(1)).alias("k"), F.max("vid").alias("vid"))
    n = per_line.groupBy("jid").agg(F.count(F.lit(1)).alias("n_vis"))
    own = per_line.where("k = 1").groupBy("jid", "vid").agg(F.count(F.lit(1)).alias("per"))
    ev = events.withColumn("vid", F.explode("vessels"))
    a = ev.join(own, ["jid", "vid"], "left").groupBy("jid", "ev").agg(
        F.first("kind").alias("kind"), F.first("type").alias("type"), F.expr("count_if(per > 0)").alias("n_pos"),
        F.count(F.lit(1)).alias("n_ves"), F.expr("coalesce(sum(per), 0)").alias("s"))
    touched = (ev.select("jid", "ev", "vid").join(lines.distinct(), ["jid", "vid"]).select("jid", "ev", "line").distinct()
               .groupBy("jid", "ev").agg(F.count(F.lit(1)).alias("own")))
    a = a.join(touched, ["jid", "ev"], "left").na.fill(0, ["own"]).withColumn("shows", F.expr("""
        case when kind = 'node' then n_pos >= 3 when kind in ('crossing', 'touching') then n_pos = n_ves and s >= 3
             else n_pos = n_ves end"""))
    j = a.groupBy("jid").agg(F.count(F.lit(1)).alias("n_ev"), F.expr("count_if(shows)").alias("n_show"),
                             F.expr("min_by(struct(kind, type), ev)").alias("first_ev"),
                             F.expr("min_by(struct(kind, type, own), case when shows then ev end)").alias("e"))
    return j.join(n, "jid", "left").na.fill(0, ["n_vis"]).selectExpr("jid", "n_vis", """
        case when n_vis <= 2 then 'none'
             when n_show = 0 then case when n_ev >= 2 then 'compound' when first_ev.kind = 'node' then first_ev.type
                                       when n_vis = 3 then 'pseudo-T' else 'crossing' end
             when n_show >= 2 or e.own < n_vis then 'compound'
             when e.kind in ('crossing', 'touching') and e.own = 3 then 'pseudo-T'
             when e.kind = 'vis_end' and e.own >= 4 then 'crossing' else e.type end as type_visible""")


def pair_arms(arms: DataFrame, max_turn: float, keys=("jid",)) -> DataFrame:
    """Pairs of directions at a node, straightest first, each once, up to a turn. Greedy choice equals rounds in which
    every pair that is the best for both its arms is taken. arms: keys, ang (whole degrees, distinct per node, so a
    node has at most 360)."""
    k = list(keys)
    a, b = arms.selectExpr(*k, "ang as a"), arms.selectExpr(*k, "ang as b")
    d = "abs(a - b)"
    p = a.join(b, k).where("a < b").withColumn("turn", F.expr(f"180 - least({d}, 360 - {d})")).where(f"turn <= {max_turn}")
    return greedy_pairs(p, "turn", k)


def greedy_pairs(pairs: DataFrame, cost: str, keys) -> DataFrame:
    """Pairs (keys, a, b, cost) taken cheapest first, every end once: rounds of the pairs that are best for both ends."""
    k = list(keys)
    p, out = checkpointed(pairs.select(*k, "a", "b", cost)), None
    while not p.isEmpty():
        key = f"struct({cost}, a, b)"
        best = (p.selectExpr(*k, "a as m", cost, "a", "b").unionByName(p.selectExpr(*k, "b as m", cost, "a", "b"))
                .groupBy(*k, "m").agg(F.expr(f"min({key})").alias("p")))
        got = checkpointed(best.groupBy(*k, "p").agg(F.count(F.lit(1)).alias("c")).where("c = 2")
                           .select(*k, "p.a", "p.b", f"p.{cost}"))
        out = got if out is None else out.unionByName(got)
        used = got.selectExpr(*k, "a as m").unionByName(got.selectExpr(*k, "b as m"))
        p = checkpointed(p.join(used.withColumnRenamed("m", "a"), [*k, "a"], "left_anti")
                         .join(used.withColumnRenamed("m", "b"), [*k, "b"], "left_anti"))
    return out if out is not None else p


def linkage(items: DataFrame, pairs: DataFrame, fits: DataFrame, keys=("image_id",)) -> DataFrame:
    """Complete linkage, nearest pairs first: two clusters join when every two of their items fit. items: keys, id;
    pairs: keys, a, b, d (candidates, a < b); fits: keys, a, b (all fitting pairs, a < b).

    Two clusters that do not fit never will, as clusters only grow, so their pairs are dropped at once; of the rest,
    every pair that is the nearest for both its clusters is joined in the same round. Returns keys, id, cluster (its
    smallest item)."""
    k = list(keys)
    c = checkpointed(items.selectExpr(*k, "id", "id as cluster"))
    p = checkpointed(pairs.select(*k, "a", "b", "d"))
    f = checkpointed(fits.select(*k, "a", "b"))
    while True:
        ca, cb = c.selectExpr(*k, "id as a", "cluster as ka"), c.selectExpr(*k, "id as b", "cluster as kb")
        size = c.groupBy(*k, "cluster").agg(F.count(F.lit(1)).alias("n"))
        side = ["least(ka, kb) as ka", "greatest(ka, kb) as kb"]
        have = (f.join(ca, [*k, "a"]).join(cb, [*k, "b"]).where("ka <> kb").selectExpr(*k, *side)
                .groupBy(*k, "ka", "kb").agg(F.count(F.lit(1)).alias("h")))
        fit = (have.join(size.selectExpr(*k, "cluster as ka", "n as na"), [*k, "ka"])
               .join(size.selectExpr(*k, "cluster as kb", "n as nb"), [*k, "kb"]).where("h = na * nb").select(*k, "ka", "kb"))
        m = checkpointed(p.join(ca, [*k, "a"]).join(cb, [*k, "b"]).where("ka <> kb").selectExpr(*k, "a", "b", "d", *side)
                         .join(fit, [*k, "ka", "kb"], "left_semi"))
        if m.isEmpty():
            return c
        near = (m.selectExpr(*k, "ka as q", "struct(d, a, b, ka, kb) as s").unionByName(
            m.selectExpr(*k, "kb as q", "struct(d, a, b, ka, kb) as s")).groupBy(*k, "q").agg(F.min("s").alias("s")))
        pick = near.groupBy(*k, "s").agg(F.count(F.lit(1)).alias("c")).where("c = 2").selectExpr(
            *k, "s.kb as cluster", "s.ka as _to")
        # picked pairs share no cluster, so one step moves every joined cluster to its partner
        c = checkpointed(c.join(pick, [*k, "cluster"], "left").selectExpr(*k, "id", "coalesce(_to, cluster) as cluster"))
        p = m.select(*k, "a", "b", "d")


def chain_positions(links: DataFrame) -> DataFrame:
    """id, start, pos for chains given as (id, next): every member's first element and its distance from it, by
    doubling. Links must not share a target; chains that run in a circle are left out."""
    t = checkpointed(links.selectExpr("next as id", "id as head", "1L as pos"))
    for _ in range(max(1, t.count().bit_length())):
        n = checkpointed(t.join(t.selectExpr("id as head", "head as _h", "pos as _p"), "head", "left").selectExpr(
            "id", "coalesce(_h, head) as head", "pos + coalesce(_p, 0L) as pos", "_h is not null as moved"))
        done = n.where("moved").isEmpty()
        t = n.drop("moved")
        if done:
            break
    else:
        t = t.join(t.selectExpr("id as head"), "head", "left_anti")
    starts = links.selectExpr("id").join(links.selectExpr("next as id"), "id", "left_anti")
    return t.selectExpr("id", "head as start", "pos").unionByName(starts.selectExpr("id", "id as start", "0L as pos"))
