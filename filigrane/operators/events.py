"""From samples to junctions: events (crossings, touchings, fading ends), their clusters, claims and arms, and the
lines that remain visible between them."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane import tables as T
from filigrane.functions import columns as C
from filigrane.operators import event_image as M
from filigrane.operators import relate as J
from filigrane.operators import runs as R
from filigrane.operators import rules as U
from filigrane.operators.grid import grid_join, tag
from filigrane.operators.network import connected_components
from filigrane.operators.quantile import quantiles
from filigrane.operators.scan import CHUNK, at_positions, groups_by_break, running
from filigrane.session import checkpointed

E = list(R.EDGE)
MARGIN = "greatest(3L, cast(ceil((2 * st + 1) / ds) as long))"
#: Discs and events of an image that is clustered in one task; rows of the images that make up a task.
DISCS, EVENTS, DEALT = 1 << 15, 1 << 11, 1 << 16


def crossing_cores(crossings: DataFrame, samples: DataFrame, runs: DataFrame, seen: str = "seen") -> DataFrame:
    """Both cores of every crossing: the run of unresolved samples around it, at least the straight-line extent where
    the other edge is seen. ev, image_id, kind, x, y, vid, lo, hi, anchor."""
    c = crossings.withColumn("ev", F.expr("concat_ws(':', 'x', image_id, a, b, i, j)"))
    cols = "ev, image_id, x, y, angle_deg"
    side = c.selectExpr(*cols.split(", "), "a as vid", "b as other", "i as anchor", "j as at_other").unionByName(
        c.selectExpr(*cols.split(", "), "b as vid", "a as other", "j as anchor", "i as at_other"))
    # the margin is taken at the crossing; merged stretches need one margin per pair, the largest along the edge
    m = samples.groupBy(*E).agg(F.expr(f"max({MARGIN})").alias("m"), F.max("i").alias("last"))
    iv = (runs.selectExpr("image_id", "a as vid", "b as other", "i0 as lo", "i1 as hi").join(m.drop("last"), E))
    k = [*E, "other", "m"]
    anchors = side.join(m.drop("last"), E).select(*k, "anchor").distinct()
    ext = R.chain_around(iv, k, anchors, "m").drop("m").withColumnRenamed("lo", "_lo").withColumnRenamed("hi", "_hi")
    own = samples.selectExpr(*E, "i as anchor", "r", "st", "ds")
    oth = samples.selectExpr("image_id", "vid as other", "i as at_other", "r as ro", "st as so", f"{seen} as seen_other")
    d = at_positions(at_positions(side, ext, [*E, "other", "anchor"], "left"), own, [*E, "anchor"])
    d = at_positions(d, oth, ["image_id", "other", "at_other"]).join(m.drop("m"), E)
    g = C.doubles(C.g_res("r", "ro", "st", "so"))
    d = d.withColumn("_e", F.expr(
        f"cast(ceil((ro + {g} + r * abs(cos(radians(angle_deg)))) / greatest(sin(radians(angle_deg)), 0.1D) / ds) as long)"))
    return d.selectExpr(
        "ev", "image_id", "'crossing' as kind", "x", "y", "vid",
        "least(coalesce(_lo, anchor), case when seen_other then greatest(anchor - _e, 0L) else anchor end) as lo",
        "greatest(coalesce(_hi, anchor), case when seen_other then least(anchor + _e, last) else anchor end) as hi", "anchor")


def touching_cores(runs: DataFrame, samples: DataFrame, taken: DataFrame, crossings: DataFrame) -> DataFrame:
    """Unresolved stretches that no crossing explains, grouped where their partner ranges meet; split into where the two
    meet and where they part when longer than 2 lambda."""
    k = ["image_id", "p", "q"]
    r = runs.selectExpr("image_id", "least(a, b) as p", "greatest(a, b) as q", "a < b as fwd",
                        "concat_ws(':', image_id, a, b, i0) as id",
                        "case when a < b then i0 else j0 end as p0", "case when a < b then i1 else j1 end as p1",
                        "case when a < b then j0 else i0 end as q0", "case when a < b then j1 else i1 end as q1")
    # runs inside a crossing's core of the same pair are used up
    t = taken.selectExpr("image_id", "ev", "vid", "lo", "hi")
    pair = t.selectExpr("image_id", "ev", "vid as p", "lo as tp0", "hi as tp1").join(
        t.selectExpr("image_id", "ev", "vid as q", "lo as tq0", "hi as tq1"), ["image_id", "ev"]).where("p < q")
    used = r.join(pair, k).where("p0 <= tp1 and p1 >= tp0 and q0 <= tq1 and q1 >= tq0").select("id").distinct()
    r = checkpointed(r.join(used, "id", "left_anti"))

    def meet(lo, hi, cond):
        """Pairs of runs of one pair whose ranges meet, found in the stretches of 64 samples they cover."""
        b = r.withColumn("_b", F.expr(f"explode(sequence(greatest({lo} - 3, 0L) div 64, ({hi} + 3) div 64))"))
        x, y = tag(b, "x", [*k, "_b"]), tag(b, "y", [*k, "_b"])
        return x.join(y, [*k, "_b"]).where(f"x_id < y_id and x_{lo} <= y_{hi} + 3 and y_{lo} <= x_{hi} + 3 and ({cond})")
    links = (meet("q0", "q1", "x_fwd or y_fwd").select("x_id", "y_id")
             .unionByName(meet("p0", "p1", "not x_fwd or not y_fwd").select("x_id", "y_id")).distinct())
    comp = connected_components(links.selectExpr("x_id as src", "y_id as dst"), r.selectExpr("id as node"))
    g = r.join(comp.withColumnRenamed("node", "id"), "id").groupBy(*k, "comp").agg(
        F.min("p0").alias("p0"), F.max("p1").alias("p1"), F.min("q0").alias("q0"), F.max("q1").alias("q1"))
    g = checkpointed(g)
    # not where both cores lie in the cores of other events, nor where the centrelines cross
    for v, lo, hi, name in (("p", "p0", "p1", "in_p"), ("q", "q0", "q1", "in_q")):
        f = J.overlap_flag(g.selectExpr("image_id", "comp", f"{v} as vid", f"{lo} as lo", f"{hi} as hi"),
                           taken.select("image_id", "vid", "lo", "hi"), E, name)
        g = g.join(f.select("comp", name), "comp")
    x = crossings.selectExpr("image_id", "a as p", "b as q", "i", "j")
    real = g.join(x, k).where("i between p0 and p1 and j between q0 and q1").select("comp").distinct()
    g = checkpointed(g.where("not (in_p and in_q)").join(real, "comp", "left_anti"))
    # one event in the middle, or one at each end
    cap = f"cast(ceil({T.LAMBDA_PX * 0.5}D) as long)"
    pos = samples.select(*E, "i", "x", "y")
    pp = pos.selectExpr("image_id", "vid as p", "i as ip", "x as xp", "y as yp")
    pq = pos.selectExpr("image_id", "vid as q", "i as iq", "x as xq", "y as yq")
    whole = g.where(f"greatest(p1 - p0, q1 - q0) <= {2 * T.LAMBDA_PX}D").selectExpr(
        *k, "comp", "'whole' as part", "(p0 + p1) div 2 as ip", "(q0 + q1) div 2 as iq", "p0", "p1", "q0", "q1")
    long = g.where(f"greatest(p1 - p0, q1 - q0) > {2 * T.LAMBDA_PX}D")
    near = at_positions(long, pp.withColumnRenamed("ip", "p0"), ["image_id", "p", "p0"])
    near = at_positions(near, pq.selectExpr("image_id", "q", "iq as q0", "xq as ax", "yq as ay"), ["image_id", "q", "q0"])
    near = (at_positions(near, pq.selectExpr("image_id", "q", "iq as q1", "xq as bx", "yq as by"), ["image_id", "q", "q1"])
            .withColumn("same", F.expr("power(xp - ax, 2) + power(yp - ay, 2) <= power(xp - bx, 2) + power(yp - by, 2)")))
    ends = near.selectExpr(
        *k, "comp", "p0", "p1", "q0", "q1", "stack(2, 'start', p0, case when same then q0 else q1 end, "
        "'end', p1, case when same then q1 else q0 end) as (part, ip, iq)").selectExpr(
        *k, "comp", "part", "ip", "iq",
        f"case when ip = p0 then p0 else greatest(p1 - {cap}, p0) end as p0",
        f"case when ip = p0 then least(p0 + {cap}, p1) else p1 end as p1",
        f"case when iq = q0 then q0 else greatest(q1 - {cap}, q0) end as q0",
        f"case when iq = q0 then least(q0 + {cap}, q1) else q1 end as q1")
    d = at_positions(whole.unionByName(ends.select(whole.columns)), pp, ["image_id", "p", "ip"])
    d = (at_positions(d, pq, ["image_id", "q", "iq"]).withColumn("ev", F.expr("concat_ws(':', 't', comp, part)")))
    both = d.selectExpr("ev", "image_id", "'touching' as kind", "(xp + xq) / 2 as x", "(yp + yq) / 2 as y",
                        "stack(2, p, p0, p1, ip, q, q0, q1, iq) as (vid, lo, hi, anchor)")
    return both


def fading_cores(ends: DataFrame, samples: DataFrame) -> DataFrame:
    """Cores of a fading end: its edge from the end to its closest approach ahead, and the other edge around the point
    it fades at."""
    pos = samples.select(*E, "i", "x", "y", "r", "st", "ds")
    last = samples.groupBy(*E).agg(F.max("i").alias("last"))
    q = pos.selectExpr("image_id", "vid as onto", "i as onto_i", "x as qx", "y as qy", "r as qr", "st as qst")
    e = (at_positions(at_positions(ends, pos.select(*E, "i", "r"), [*E, "i"]), q, ["image_id", "onto", "onto_i"])
         .withColumn("ev", F.expr("concat_ws(':', 'f', image_id, vid, i, sgn)")))
    a = (e.withColumn("_k", F.explode(F.expr(f"sequence(0L, cast(ceil({T.LAMBDA_PX}D + r + qr) as long))")))
         .withColumn("_i", F.expr("i + sgn * _k")))
    a = at_positions(a, pos.selectExpr(*E, "i as _i", "x", "y"), [*E, "_i"])
    near = a.groupBy("ev").agg(F.expr("min_by(_i, struct(power(x - qx, 2) + power(y - qy, 2), _k))").alias("cl"))
    own = e.join(near, "ev").selectExpr("ev", "image_id", "'vis_end' as kind", "qx as x", "qy as y", "vid",
                                        "least(i, cl) as lo", "greatest(i, cl) as hi", "i as anchor")
    other = e.join(last.withColumnRenamed("vid", "onto"), ["image_id", "onto"]).selectExpr(
        "ev", "image_id", "'vis_end' as kind", "qx as x", "qy as y", "onto as vid",
        "greatest(onto_i - cast(ceil(r + 2 * qst) as long), 0L) as lo",
        "least(onto_i + cast(ceil(r + 2 * qst) as long), last) as hi", "onto_i as anchor")
    return own.unionByName(other)


def drop_redundant(cores: DataFrame) -> DataFrame:
    """Fading ends of a pair that also crosses or touches are explained by that. cores is read three times."""
    pair = cores.groupBy("image_id", "ev", "kind").agg(F.min("vid").alias("p"), F.max("vid").alias("q"))
    solid = pair.where("kind <> 'vis_end'").select("image_id", "p", "q").distinct()
    gone = pair.where("kind = 'vis_end'").join(solid, ["image_id", "p", "q"]).select("ev")
    return cores.join(gone, "ev", "left_anti")


def cluster_events(cores: DataFrame, samples: DataFrame, discs: int = DISCS, events: int = EVENTS):
    """Events whose regions (discs of their core samples within 2 lambda of the centre) intersect, by complete linkage.
    Returns (image_id, ev, cluster, x, y, extent).

    Images are independent: one of at most so many discs and events is clustered in one task (`event_image`), the others by joins. An image
    with a place or reach that is NaN is left to the joins."""
    d = (R.interval_samples(cores, samples.select(*E, "i", samples["x"].alias("sx"), samples["y"].alias("sy"), "r", "st"), E)
         .withColumn("w", F.expr("r + st")).withColumn("d", F.expr("sqrt(power(sx - x, 2) + power(sy - y, 2))"))
         .where(f"d <= {2 * T.LAMBDA_PX}D"))
    d = checkpointed(d.groupBy("image_id", "ev", "sx", "sy").agg(F.max("w").alias("w"), F.max("d").alias("d")))
    ext = d.groupBy("image_id", "ev").agg(F.expr("max(d + w)").alias("extent"))
    ev = checkpointed(cores.groupBy("image_id", "ev").agg(F.min("x").alias("x"), F.min("y").alias("y"))
                      .join(ext, ["image_id", "ev"]))
    size = d.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ev").alias("m"), F.expr(
        "bool_and(coalesce(not isnan(sx + sy + w + d), false))").alias("whole"))
    sound = ev.groupBy("image_id").agg(F.expr("bool_and(coalesce(not isnan(x + y + extent), false))").alias("sound"))
    images = checkpointed(size.join(sound, "image_id").where(f"whole and sound and n <= {discs} and m <= {events}").select("image_id", "n", "m"))
    done = None
    if not images.isEmpty():
        done = checkpointed(_in_memory(d, ev, images))
        d, ev = (t.join(images, "image_id", "left_anti") for t in (d, ev))
        if ev.isEmpty():
            return done
        d, ev = checkpointed(d), checkpointed(ev)
    p = d.selectExpr("image_id", "ev", "sx as x", "sy as y", "w")
    hits = J.reach_join(tag(p, "a"), tag(p, "b"), "a_w", "b_w", T.REACH_CLASSES, "a_ev < b_ev").selectExpr(
        "image_id", "a_ev as a", "b_ev as b").distinct()
    e1, e2 = tag(ev, "a"), tag(ev, "b")
    # an extent is at most 2 lambda plus a disc
    reach = 2 * float(ev.agg(F.max("extent")).first()[0] or 1.0)
    fits = grid_join(e1, e2, reach, f"a_ev < b_ev and sqrt({J.D2}) <= a_extent + b_extent").selectExpr(
        "image_id", "a_ev as a", "b_ev as b", f"sqrt({J.D2}) as d")
    fits = checkpointed(fits)
    pairs = hits.join(fits, ["image_id", "a", "b"])
    c = U.linkage(ev.selectExpr("image_id", "ev as id"), pairs, fits)
    by_joins = ev.join(c.selectExpr("image_id", "id as ev", "cluster"), ["image_id", "ev"])
    return checkpointed(by_joins if done is None else done.unionByName(by_joins))


def _in_memory(d: DataFrame, ev: DataFrame, images: DataFrame) -> DataFrame:
    """Clusters of the images' events, image by image in tasks of about DEALT rows."""
    given = (d.selectExpr("cast(image_id as long) as image_id", "ev", "true as disc", "sx as x", "sy as y", "cast(w as double) as w")
             .unionByName(ev.selectExpr("cast(image_id as long) as image_id", "ev", "false as disc", "x", "y", "cast(extent as double) as w"))
             .join(images.select("image_id"), "image_id", "left_semi"))
    n, k = images.agg(F.expr("sum(n + m)"), F.count(F.lit(1))).first()
    tasks = max(1, -(-n // DEALT), min(k, 2 * d.sparkSession.sparkContext.defaultParallelism))
    return given.repartition(tasks, "image_id").groupBy("image_id").applyInArrow(M.clusters, M.FOUND)


def junction_table(samples: DataFrame, w: int, h: int):
    """The whole way from samples (with a mask `seen`) to junctions. Returns (junctions, claims, arms)."""
    s = checkpointed(samples)
    rec = checkpointed(J.pair_records(s.where("seen")))
    res = checkpointed(R.record_runs(rec.where("unresolved")))
    x = checkpointed(J.crossings(s).where(C.doubles(C.in_frame("x", "y", w, h))))
    cc = checkpointed(crossing_cores(x, s, res))
    tc = touching_cores(res, s, cc, x)
    fc = fading_cores(J.fading_ends(s, "seen", w, h), s)
    cores = checkpointed(drop_redundant(checkpointed(cc.unionByName(tc).unionByName(fc))).where(C.doubles(C.in_frame("x", "y", w, h))))
    ev = cluster_events(cores, s)
    # centre: the event nearest the mean of a cluster; radius: its farthest event's region
    mean = ev.groupBy("image_id", "cluster").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"),
                                                 F.count(F.lit(1)).alias("n_events"))
    cen = ev.join(mean, ["image_id", "cluster"]).groupBy("image_id", "cluster", "n_events").agg(
        F.expr("min_by(struct(x, y), struct(power(x - mx, 2) + power(y - my, 2), ev))").alias("c"))
    kinds = cores.select("image_id", "ev", "kind").distinct().join(ev.select("image_id", "ev", "cluster"), ["image_id", "ev"])
    typ = kinds.groupBy("image_id", "cluster").agg(F.expr(
        "case when count(1) > 1 then 'compound' else max(case kind when 'vis_end' then 'pseudo-T' else kind end) end")
        .alias("type"))
    rad = ev.join(cen, ["image_id", "cluster"]).groupBy("image_id", "cluster").agg(
        F.expr("max(sqrt(power(x - c.x, 2) + power(y - c.y, 2)) + extent)").alias("radius"))
    jn = checkpointed(cen.join(typ, ["image_id", "cluster"]).join(rad, ["image_id", "cluster"]).selectExpr(
        "image_id", "cluster as jid", "c.x as x", "c.y as y", "radius", "type", "n_events"))
    m = s.groupBy(*E).agg(F.expr(f"max({MARGIN})").alias("m"), F.max("i").alias("last"))
    iv = cores.join(ev.select("image_id", "ev", "cluster"), ["image_id", "ev"]).join(m.drop("last"), E)
    merged = R.merge_intervals(iv.selectExpr(*E, "cluster as jid", "m", "lo", "hi"), [*E, "jid", "m"], "2 * m").drop("m")
    clipped = R.clip_intervals(
        merged.join(jn.selectExpr("image_id", "jid", "x as cx", "y as cy", "radius"), ["image_id", "jid"]),
        s.select(*E, "i", "x", "y"))
    cl = checkpointed(clipped.selectExpr(*E, "jid", "lo2 as lo", "hi2 as hi"))
    shared = R.owner_runs(R.share_out(cl, E, ["jid"], "(lo + hi) div 2", ["lo", "hi", "jid"]), E)
    lim = R.claim_limits(shared, E, "9223372036854775806L", "jid")
    pts = R.arm_points(lim.join(m, E), "m", "last")
    claims = checkpointed(pts.selectExpr(*E, "owner.jid as jid", "lo", "hi", "in_at", "out_at", "in_crowded", "out_crowded",
                                         "last"))
    arms = claims.selectExpr(*E, "jid", "stack(2, in_at, -1, lo > 0, out_at, 1, hi < last) as (i, sgn, open)").where(
        "open").drop("open")
    med = R.window_medians(arms, s.select(*E, "i", "cnr", "in_frame"), 12, {"cnr": "cnr"}, "in_frame",
                           ids=("image_id", "vid", "jid", "i", "sgn"))
    arms = checkpointed(arms.join(med, ["image_id", "vid", "jid", "i", "sgn"], "left").withColumn("visibility", F.expr(
        f"case when cnr is null then 'out_of_frame' when cnr >= {T.CNR_REQUIRED} then 'visible' "
        f"when cnr >= {T.CNR_VISIBLE} then 'faint' else 'invisible' end")))
    n = arms.groupBy("image_id", "jid").agg(F.count(F.lit(1)).alias("n_arms"),
                                            F.expr("count_if(visibility in ('visible', 'faint'))").alias("n_visible"))
    return jn.join(n, ["image_id", "jid"], "left").na.fill(0, ["n_arms", "n_visible"]), claims, arms


def merge_stretches(records: DataFrame, samples: DataFrame, gap: int = 6) -> DataFrame:
    """Stretches where two observable edges are one line: which of them is the weaker (by median contrast, radius, then
    the larger number), left out where their blurs differ too much. records: image_id, a < b, i, j."""
    k = ["image_id", "a", "b"]
    d = records.withColumn("_ck", F.expr(f"i div {CHUNK}"))
    g = d.groupBy(*k, "i", "_ck").agg(F.lit(1).alias("one"))
    g = groups_by_break(g, k, ["i"], "_ck", {"_p": ("max", "i")}, f"_p is null or i - _p > {gap}").select(*k, "i", "_run")
    d = at_positions(records, g, [*k, "i"])
    at = samples.selectExpr("image_id", "vid", "i", "coalesce(contrast, 0.0D) as prom", "r", "st")
    d = at_positions(d, at.selectExpr("image_id", "vid as a", "i", "prom as pa", "r as ra", "st as sa"), ["image_id", "a", "i"])
    d = checkpointed(at_positions(d, at.selectExpr("image_id", "vid as b", "i as j", "prom as pb", "r as rb", "st as sb"), ["image_id", "b", "j"]))
    long = d.selectExpr(*k, "_run", "stack(6, 'pa', pa, 'pb', pb, 'ra', ra, 'rb', rb, 'sa', sa, 'sb', sb) as (q, v)")
    med = quantiles(long, [*k, "_run", "q"], "v", {"m": 0.5}).groupBy(*k, "_run").agg(
        *[F.expr(f"max(case when q = '{n}' then m end)").alias(n) for n in ("pa", "pb", "ra", "rb", "sa", "sb")])
    span = d.groupBy(*k, "_run").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"),
                                     F.max("j").alias("j1"))
    return (at_positions(span, med, [*k, "_run"])
            .where(f"greatest(sa, sb) <= {T.MERGE_BLUR_RATIO} * least(sa, sb)")
            .withColumn("a_weaker", F.expr("struct(pa, ra, -a) < struct(pb, rb, -b)"))
            .selectExpr(*k, "i0", "i1", "j0", "j1", "case when a_weaker then a else b end as weaker",
                        "case when a_weaker then b else a end as stronger"))


def extend_lines(samples: DataFrame, claims: DataFrame, reach: int = 6) -> DataFrame:
    """Lines carried on into claims: through one with line on both sides within `reach`, else up to the last (or first)
    line sample in it. Every claim only adds samples, so rounds over all claims at once end in the same lines.
    samples: image_id, vid, i, line, in_frame; claims: image_id, vid, lo, hi."""
    s = checkpointed(samples)
    cl = checkpointed(claims.select(*E, "lo", "hi").distinct())
    while True:
        d = running(s.withColumn("_ck", F.expr(f"i div {CHUNK}")), E, ["i"], "_ck",
                    {"_b": ("max", "case when line then i end"), "_a": ("min", "case when line then i end", "back")})
        d = checkpointed(d.select(*E, "i", "_b", "_a"))
        before = d.selectExpr(*E, "i + 1 as lo", "_b as left")
        after = d.selectExpr(*E, "i - 1 as hi", "_a as right")
        c = at_positions(at_positions(cl, before, [*E, "lo"], "left"), after, [*E, "hi"], "left")
        c = at_positions(c, d.selectExpr(*E, "i as hi", "_b as last_in"), [*E, "hi"])
        c = at_positions(c, d.selectExpr(*E, "i as lo", "_a as first_in"), [*E, "lo"])
        c = c.selectExpr(*E, "lo", "hi", f"case when lo - left <= {reach} then left end as left",
                         f"case when right - hi <= {reach} then right end as right",
                         "case when last_in >= lo then last_in end as last_in",
                         "case when first_in <= hi then first_in end as first_in")
        c = c.selectExpr(*E, """case when left is not null then left + 1
                               when right is not null then coalesce(first_in, hi) end as f0""",
                         """case when left is not null and right is not null then right - 1
                               when left is not null then coalesce(last_in, lo)
                               when right is not null then right - 1 end as f1""").where("f0 <= f1")
        fill = c.withColumn("i", F.explode(F.expr("sequence(f0, f1)"))).select(*E, "i").distinct().withColumn(
            "_f", F.lit(True))
        s2 = checkpointed(at_positions(s, fill, [*E, "i"], "left").withColumn("_new", F.expr(
            "coalesce(_f, false) and in_frame and not line")).drop("_f"))
        grown = not s2.where("_new").isEmpty()
        s = s2.withColumn("line", F.expr("line or _new")).drop("_new")
        if not grown:
            return s
