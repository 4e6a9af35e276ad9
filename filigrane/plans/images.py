"""Queries that put whole images together: per-image analysis, line groups, spectra, bridged gaps."""
from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from filigrane.operators import raster as A
from filigrane.operators import rules as U
from filigrane.operators.quantile import median_abs_dev, quantiles
from filigrane.plans import relations  # noqa: F401  (defines the gap candidates)
from filigrane.plans.registry import ORACLES, QUERIES, query
from filigrane.session import checkpointed
from filigrane.sources import views as V


def analyse_images(px, w: str, h: str):
    """Statistics of every image as long rows (image_id, key, value)."""
    px = checkpointed(px)
    q = quantiles(px, ["image_id"], "value", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    sd = px.groupBy("image_id").agg(F.expr("stddev_pop(value)").alias("sd"))
    noise = median_abs_dev(checkpointed(A.laplacian(px, "value", w, h)), ["image_id"], "lap").selectExpr(
        "image_id", "1.4826D * mad / sqrt(20.0D) as noise")
    band = A.difference_of_gaussians(px, "value", 1.0, w, h, "v").groupBy("image_id").agg(F.expr("stddev_pop(v)").alias("bg"))
    r = q.join(sd, "image_id").join(noise, "image_id").join(band, "image_id")
    return r.selectExpr("image_id", "stack(6, 'F_p05', p05, 'F_p50', p50, 'F_p95', p95, 'F_std', sd, 'noise', noise, "
                        "'bg:1', bg) as (key, value)")


RAS_SQL = """
  select image_id, key, round(value, 6) as value from (
    select image_id, 'F_p05' as key, quantile_cont(value, 0.05) as value from pixels group by image_id
    union all select image_id, 'F_p50', median(value) from pixels group by image_id
    union all select image_id, 'F_p95', quantile_cont(value, 0.95) from pixels group by image_id
    union all select image_id, 'F_std', stddev_pop(value) from pixels group by image_id
    union all select image_id, 'bg:1', stddev_pop(v) from dog group by image_id
    union all select image_id, 'noise', 1.4826 * median(abs(lap - m)) / sqrt(20) from (
      select *, median(lap) over (partition by image_id) as m from lap) group by image_id)"""


@query("ras05_image_analysis", "pixels dog lap", RAS_SQL)
def ras05(spark, sf):
    return analyse_images(V.pixels(spark, sf), "8", "8").withColumn("value", F.expr("round(value, 6)"))


@query("src16_reference_from_images", "pixels dog lap", f"""
  , s as ({RAS_SQL}) select key, count(*) as n, round(avg(value), 5) as mean, round(stddev_samp(value), 5) as sd from s
  group by key""")
def src16(spark, sf):
    """A reference made from a set of images: analysed, then summarised per key."""
    from filigrane.operators.scorecard import summarise
    s = analyse_images(V.pixels(spark, sf), "8", "8").withColumn("value", F.expr("round(value, 6)"))
    return summarise(s).selectExpr("key", "n", "round(mean, 5) as mean", "round(sd, 5) as sd")


@query("pro02_line_groups", "sections", """
  , m as (select * from (select *, lag(v) over w as l, lead(v) over w as r from sections window w as (partition by vec_id
    order by t)) where v < l and v < r),
  lo as (select m.vec_id, m.t, any_value(m.v) as v, coalesce(max(s.t) filter (s.t < m.t and s.v < m.v), -1) as a,
      coalesce(min(s.t) filter (s.t > m.t and s.v < m.v), 64) as b from m join sections s on s.vec_id = m.vec_id
    group by m.vec_id, m.t),
  p as (select lo.vec_id, lo.t, least(max(s.v) filter (s.t < lo.t), max(s.v) filter (s.t > lo.t)) - any_value(lo.v) as prom
    from lo join sections s on s.vec_id = lo.vec_id and s.t > lo.a and s.t < lo.b group by lo.vec_id, lo.t),
  c as (select vec_id, arg_min(t, {'d': abs(t - 32), 't': t}) as c from p group by vec_id),
  k as (select p.*, c.c, p.t = c.c as mid from p join c on c.vec_id = p.vec_id where prom >= 0.15 or p.t = c.c),
  g as (select *, sum(case when q is null or t - q > 6 then 1 else 0 end) over (partition by vec_id order by t) as grp from (
    select *, lag(t) over (partition by vec_id order by t) as q from k))
  select g.vec_id, cast(any_value(c) as bigint) as center, count(*) as n_lines from g
  join (select vec_id, grp from g where mid) h on h.vec_id = g.vec_id and h.grp = g.grp group by g.vec_id""")
def pro02(spark, sf):
    """Parallel lines across a section of 64 samples: local minima that stand out, chained by their spacing, counted in
    the group of the central one. A section has a fixed length, so its windows do too."""
    s = checkpointed(V.table(spark, sf, "embeddings").selectExpr("vec_id", "posexplode(embedding) as (t, e)").selectExpr(
        "vec_id", "cast(t as bigint) as t", "cast(e as double) as v"))
    w = Window.partitionBy("vec_id").orderBy("t")
    m = s.withColumn("l", F.lag("v").over(w)).withColumn("r", F.lead("v").over(w)).where("v < l and v < r").selectExpr(
        "vec_id", "t as mt", "v as mv")
    j = m.join(s, "vec_id")
    lo = j.groupBy("vec_id", "mt", "mv").agg(F.expr("coalesce(max(case when t < mt and v < mv then t end), -1)").alias("a"),
                                             F.expr("coalesce(min(case when t > mt and v < mv then t end), 64)").alias("b"))
    p = checkpointed(lo.join(s, "vec_id").where("t > a and t < b").groupBy("vec_id", "mt", "mv").agg(F.expr(
        "least(max(case when t < mt then v end), max(case when t > mt then v end)) - mv").alias("prom")))
    c = p.groupBy("vec_id").agg(F.expr("min_by(mt, struct(abs(mt - 32), mt))").alias("center"))
    k = p.join(c, "vec_id").where("prom >= 0.15D or mt = center")
    wk = Window.partitionBy("vec_id").orderBy("mt")
    k = k.withColumn("q", F.lag("mt").over(wk)).withColumn("brk", F.expr("case when q is null or mt - q > 6 then 1 else 0 end"))
    k = k.withColumn("grp", F.sum("brk").over(wk))
    mid = k.where("mt = center").select("vec_id", "grp")
    return k.join(mid, ["vec_id", "grp"]).groupBy("vec_id", "center").agg(F.count(F.lit(1)).alias("n_lines"))


@query("skl08_bridge_gaps", "", """
  select image_id, a, b, cost from (
    with recursive c as (select image_id, a * 2 + sa as a, b * 2 + sb as b, cost, row_number() over (partition by image_id
        order by cost, a * 2 + sa, b * 2 + sb) as n from (""" + ORACLES["jn22_gap_candidates"] + """)),
    walk as (
      select distinct image_id, 0::bigint as n, []::bigint[] as used, false as ok, 0::bigint as a, 0::bigint as b, 0::double as cost from c
      union all
      select image_id, n, case when ok then list_concat(used, [a, b]) else used end, ok, a, b, cost from (
        select c.image_id, c.n, v.used, c.a, c.b, c.cost, not list_contains(v.used, c.a) and not list_contains(v.used, c.b) as ok
        from walk v join c on c.image_id = v.image_id and c.n = v.n + 1))
    select * from walk) where ok""")
def skl08(spark, sf):
    """Path ends joined across gaps, cheapest first, every end once."""
    c = QUERIES["jn22_gap_candidates"](spark, sf).selectExpr("image_id", "a * 2 + sa as a", "b * 2 + sb as b", "cost")
    return U.greedy_pairs(c, "cost", ["image_id"])


def radial_power(px, tile: int, bins: int):
    """Mean power per logarithmic ring of spatial frequency, over the half-overlapping Hann-windowed tiles of an image
    that are at least 99 % there. The transform is two passes of cosine and sine sums, along x, then along y."""
    half = tile // 2
    key = ["image_id", "ty", "tx"]
    at = {c: f"filter(array({c} div {half}, {c} div {half} - 1), k -> k >= 0)" for c in "yx"}
    t = (px.where("value is not null").withColumn("ty", F.explode(F.expr(at["y"]))).withColumn("tx", F.explode(F.expr(at["x"])))
         .selectExpr(*key, f"y - {half} * ty as q", f"x - {half} * tx as n", "value"))
    full = t.groupBy(*key).agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("k")).where(f"k >= {0.99 * tile * tile!r}")
    hann = "(0.5D - 0.5D * cos(2 * pi() * {} / " + str(tile - 1) + "))"
    d = t.join(full, key).selectExpr(*key, "q", "n", f"(value - m) * {hann.format('q')} * {hann.format('n')} as c")
    turn = f"explode(sequence(0L, {tile - 1}L))"
    along = (d.withColumn("u", F.expr(turn)).groupBy(*key, "q", "u").agg(
        F.expr(f"sum(c * cos(2 * pi() * u * n / {tile}))").alias("a"), F.expr(f"sum(c * sin(2 * pi() * u * n / {tile}))").alias("b")))
    both = along.withColumn("v", F.expr(turn)).withColumn("f", F.expr(f"2 * pi() * v * q / {tile}")).groupBy(*key, "u", "v").agg(
        F.expr("sum(a * cos(f) - b * sin(f))").alias("re"), F.expr("sum(a * sin(f) + b * cos(f))").alias("im"))
    weight = sum((0.5 - 0.5 * math.cos(2 * math.pi * k / (tile - 1))) ** 2 for k in range(tile)) ** 2
    fold = "(case when {0} < " + str(half) + " then {0} else {0} - " + str(tile) + " end)"
    ring = (f"cast(floor(round({bins} * ln(sqrt(power({fold.format('u')}, 2) + power({fold.format('v')}, 2)) / 2) "
            f"/ ln({tile / 4!r}D), 9)) as long) + 1")
    return (both.where("u > 0 or v > 0").withColumn("bin", F.expr(ring)).where(f"bin between 1 and {bins}")
            .groupBy("image_id", "bin").agg(F.expr(f"round(avg(re * re + im * im) / {weight!r}D, 6)").alias("power"),
                                            F.count(F.lit(1)).alias("n")))


@query("sta14_radial_power", "pixels", """
  , m as (select image_id, avg(value) as m from pixels group by image_id having count(value) >= 64),
  w as (select p.image_id, p.y, p.x, (p.value - m.m) * (0.5 - 0.5 * cos(2 * pi() * p.y / 7)) * (0.5 - 0.5 * cos(2 * pi() * p.x / 7)) as c
    from pixels p join m on m.image_id = p.image_id),
  f as (select image_id, u, v, power(sum(c * cos(2 * pi() * (u * x + v * y) / 8)), 2)
      + power(sum(c * sin(2 * pi() * (u * x + v * y) / 8)), 2) as p
    from w, (select unnest(range(8)) as u), (select unnest(range(8)) as v) group by image_id, u, v),
  r as (select image_id, p, sqrt(power(least(u, 8 - u), 2) + power(least(v, 8 - v), 2)) / 8 as radius from f),
  k as (select image_id, p, case when radius < 0.25 * power(2, 0.25) then 1 when radius < 0.25 * power(2, 0.5) then 2
      when radius < 0.25 * power(2, 0.75) then 3 else 4 end as bin from r where radius >= 0.25 and radius < 0.5 - 1e-12)
  select image_id, bin, round(avg(p) / power((select sum(power(0.5 - 0.5 * cos(2 * pi() * n / 7), 2)) from (select unnest(range(8)) as n)), 2), 6)
    as power, count(*) as n from k group by image_id, bin""")
def sta14(spark, sf):
    return radial_power(V.pixels(spark, sf), 8, 4)
