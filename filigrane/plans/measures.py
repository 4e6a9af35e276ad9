"""Queries over image measurements: moments, tiles, profiles, paired fits, bursts, camera."""
from __future__ import annotations

from pyspark.sql import functions as F

from filigrane.operators import raster as A
from filigrane.operators import runs as R
from filigrane.operators import scorecard as S
from filigrane.operators.quantile import median_abs_dev, quantiles
from filigrane.plans import oracle
from filigrane.plans.pixels import conv_sql, ksql, refl  # noqa: F401
from filigrane.plans.registry import query
from filigrane.plans.relations import bilinear
from filigrane.session import checkpointed
from filigrane.sources import views as V

LAM = 25.0


def rnd(*cols, n=6):
    return [f"round({c}, {n}) as {c}" for c in cols]


@query("agg23_image_moments", "pixels", """
  select image_id, round(quantile_cont(value, 0.01), 6) as p01, round(quantile_cont(value, 0.05), 6) as p05,
    round(median(value), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(stddev_pop(value), 6) as sd,
    round((avg(power(value, 3)) - 3 * avg(value) * avg(value * value) + 2 * power(avg(value), 3))
      / power(stddev_pop(value), 3), 5) as skew, round(avg((value < m - 0.1)::int), 6) as dark
  from (select *, median(value) over (partition by image_id) as m from pixels) group by image_id""")
def agg23(spark, sf):
    p = V.pixels(spark, sf)
    q = quantiles(p, ["image_id"], "value", {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95})
    m = p.join(q.select("image_id", "p50"), "image_id").groupBy("image_id").agg(
        F.expr("stddev_pop(value)").alias("sd"), F.expr("skewness(value)").alias("skew"),
        F.expr("avg(cast(value < p50 - 0.1D as int))").alias("dark"))
    return q.join(m, "image_id").selectExpr("image_id", *rnd("p01", "p05", "p50", "p95", "sd"), *rnd("skew", n=5),
                                            *rnd("dark"))


@query("agg26_orientation", "skeleton", """
  select image_id, count(*) as n, round(sqrt(c * c + s * s), 6) as anisotropy,
    round((degrees(atan2(s, c)) / 2 + 180) % 180, 4) as direction from (
    select image_id, count(*) as n_, avg(cos(2 * radians((pid * 37) % 180))) as c,
      avg(sin(2 * radians((pid * 37) % 180))) as s, count(*) as n from skeleton group by image_id) group by all""".replace(
    "select image_id, count(*) as n, round", "select image_id, n, round").replace(" group by all", ""))
def agg26(spark, sf):
    d = V.skeleton(spark, sf).groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"), F.expr("avg(cos(2 * radians((pid * 37) % 180)))").alias("c"),
        F.expr("avg(sin(2 * radians((pid * 37) % 180)))").alias("s"))
    return d.selectExpr("image_id", "n", "round(sqrt(c * c + s * s), 6) as anisotropy",
                        "round((degrees(atan2(s, c)) / 2 + 180) % 180, 4) as direction")


@query("agg26_orientation_histogram", "skeleton", """
  select image_id, bin, count(*) as n, round(count(*) / sum(count(*)) over (partition by image_id), 6) as share from (
    select image_id, ((pid * 37) % 180) // 15 as bin from skeleton) group by image_id, bin""")
def agg26_hist(spark, sf):
    h = V.skeleton(spark, sf).groupBy("image_id", F.expr("((pid * 37) % 180) div 15").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    t = h.groupBy("image_id").agg(F.sum("n").alias("t"))
    return h.join(t, "image_id").selectExpr("image_id", "bin", "n", "round(n / t, 6) as share")


@query("agg27_tile_focus", "profiles", """
  select image_id, count(*) as n_tiles, round(stddev_pop(ln(m)), 6) as focus_var, round(avg((m > 1.2 * lo)::int), 6) as soft,
    round(quantile_cont(m, 0.9) / quantile_cont(m, 0.1), 6) as ratio from (
    select *, min(m) over (partition by image_id) as lo from (
      select image_id, path // 10 as tile, median(edge * (1 + l_tax)) as m from profiles where fwhm < 37.5
      group by image_id, path // 10 having count(*) >= 20)) group by image_id having count(*) >= 4""")
def agg27(spark, sf):
    """Median edge width per tile (at least 20 narrow profiles), then its spread over the tiles of an image."""
    p = V.profiles(spark, sf).where("fwhm < 37.5D").selectExpr("image_id", "path div 10 as tile", "edge * (1 + l_tax) as e")
    m = checkpointed(quantiles(p, ["image_id", "tile"], "e", {"m": 0.5}, count="n").where("n >= 20"))
    lo = m.groupBy("image_id").agg(F.min("m").alias("lo"))
    # an image has at most 20 tiles
    t = m.join(lo, "image_id").groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_tiles"), F.expr("stddev_pop(ln(m))").alias("focus_var"),
        F.expr("avg(cast(m > 1.2D * lo as int))").alias("soft"),
        F.expr("percentile(m, 0.9D) / percentile(m, 0.1D)").alias("ratio")).where("n_tiles >= 4")
    return t.selectExpr("image_id", "n_tiles", *rnd("focus_var", "soft", "ratio"))


@query("agg28_patchiness", "raster", """
  select image_id, count(*) as n_tiles, round(stddev_pop(s) / avg(s), 6) as cv from (
    select image_id, stddev_pop(price) as s from raster where value > 17 group by image_id, y // 10, x // 10
    having count(*) > 40) group by image_id""")
def agg28(spark, sf):
    t = V.raster(spark, sf).where("value > 17").groupBy("image_id", F.expr("y div 10"), F.expr("x div 10")).agg(
        F.expr("stddev_pop(price)").alias("s"), F.count(F.lit(1)).alias("n")).where("n > 40")
    return t.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_tiles"),
                                     F.expr("round(stddev_pop(s) / avg(s), 6)").alias("cv"))


@query("agg29_profile_quantiles", "profiles", """
  select image_id, round(quantile_cont(contrast, 0.1), 5) as c10, round(median(contrast), 5) as c50,
    round(quantile_cont(contrast, 0.9), 5) as c90, round(quantile_cont(fwhm, 0.1), 6) as f10, round(median(fwhm), 6) as f50,
    round(quantile_cont(fwhm, 0.9), 6) as f90, count(*) as n from profiles group by image_id""")
def agg29(spark, sf):
    p = V.profiles(spark, sf)
    c = quantiles(p, ["image_id"], "contrast", {"c10": 0.1, "c50": 0.5, "c90": 0.9}, count="n")
    f = quantiles(p, ["image_id"], "fwhm", {"f10": 0.1, "f50": 0.5, "f90": 0.9})
    return c.join(f, "image_id").selectExpr("image_id", *rnd("c10", "c50", "c90", n=5), *rnd("f10", "f50", "f90"), "n")


@query("agg29_by_scale_and_width", "profiles", """
  select image_id, scale, width_class, count(*) as n, round(case when count(*) > 20 then median(contrast) end, 5) as contrast
  from (select *, case when fwhm < 12.5 then 'hair' when fwhm < 25 then 'thin' when fwhm < 50 then 'mid' else 'wide' end
    as width_class from profiles) group by image_id, scale, width_class""")
def agg29_scale(spark, sf):
    p = V.profiles(spark, sf).withColumn("width_class", F.expr(
        "case when fwhm < 12.5D then 'hair' when fwhm < 25 then 'thin' when fwhm < 50 then 'mid' else 'wide' end"))
    q = quantiles(p, ["image_id", "scale", "width_class"], "contrast", {"m": 0.5}, count="n")
    return q.selectExpr("image_id", "scale", "width_class", "n", "round(case when n > 20 then m end, 5) as contrast")


@query("agg30_along_path_cv", "profiles", """
  , m as (select *, median(contrast) over (partition by path) as mc, median(fwhm) over (partition by path) as mf from profiles)
  select path, count(*) as n, round(1.4826 * median(abs(contrast - mc)) / any_value(mc), 6) as cv_contrast,
    round(1.4826 * median(abs(fwhm - mf)) / any_value(mf), 6) as cv_fwhm from m group by path having count(*) >= 6""")
def agg30(spark, sf):
    p = checkpointed(V.profiles(spark, sf).select("path", "contrast", "fwhm"))
    n = p.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n >= 6")
    c = median_abs_dev(p, ["path"], "contrast", "dc", "mc")
    f = median_abs_dev(p, ["path"], "fwhm", "df", "mf")
    return n.join(c, "path").join(f, "path").selectExpr(
        "path", "n", "round(1.4826D * dc / mc, 6) as cv_contrast", "round(1.4826D * df / mf, 6) as cv_fwhm")


@query("agg31_sharp_contrast", "profiles", """
  , q as (select image_id, quantile_cont(fwhm, [0.2, 0.4, 0.6, 0.8]) as e, count(*) as n from profiles group by image_id),
  b as (select p.*, (fwhm >= e[1])::int + (fwhm >= e[2])::int + (fwhm >= e[3])::int + (fwhm >= e[4])::int as bin
    from profiles p join q on q.image_id = p.image_id where n >= 60),
  t as (select image_id, bin, quantile_cont(sharp, 2 / 3.0) as t from b group by image_id, bin having count(*) >= 9),
  s as (select b.* from b join t on t.image_id = b.image_id and t.bin = b.bin where sharp >= t),
  r as (select *, rank() over (partition by image_id order by fwhm) + (count(*) over (partition by image_id, fwhm) - 1) / 2.0
      as ra, rank() over (partition by image_id order by contrast) + (count(*) over (partition by image_id, contrast) - 1)
      / 2.0 as rb from s)
  select image_id, count(*) as n, round(regr_slope(ln(contrast), ln(fwhm)), 6) as slope, round(corr(ra, rb), 6) as rho,
    round(case when count(*) filter (fwhm < 20) >= 10 then median(contrast) filter (fwhm < 20) end, 5) as c_small,
    round(case when count(*) filter (fwhm >= 20 and fwhm < 40) >= 10 then median(contrast) filter (fwhm >= 20 and fwhm < 40)
      end, 5) as c_mid from r group by image_id having count(*) >= 20""")
def agg31(spark, sf):
    """Contrast law among the sharpest third of the profiles in every width quintile."""
    p = checkpointed(V.profiles(spark, sf).select("image_id", "contrast", "fwhm", "sharp"))
    q = quantiles(p, ["image_id"], "fwhm", {"e1": 0.2, "e2": 0.4, "e3": 0.6, "e4": 0.8}, count="n").where("n >= 60")
    b = checkpointed(p.join(q, "image_id").withColumn("bin", F.expr(
        "cast(fwhm >= e1 as int) + cast(fwhm >= e2 as int) + cast(fwhm >= e3 as int) + cast(fwhm >= e4 as int)"))
        .drop("e1", "e2", "e3", "e4", "n"))
    t = quantiles(b, ["image_id", "bin"], "sharp", {"t": 2 / 3}, count="m").where("m >= 9").drop("m")
    s = checkpointed(b.join(t, ["image_id", "bin"]).where("sharp >= t"))
    rho = S.spearman(s, ["image_id"], "fwhm", "contrast")
    g = s.groupBy("image_id").agg(F.expr("regr_slope(ln(contrast), ln(fwhm))").alias("slope"))
    out = rho.where("n >= 20").join(g, "image_id")
    for name, cond in (("c_small", "fwhm < 20"), ("c_mid", "fwhm >= 20 and fwhm < 40")):
        m = quantiles(s.where(cond), ["image_id"], "contrast", {name: 0.5}, count="k").where("k >= 10").drop("k")
        out = out.join(m, "image_id", "left")
    return out.selectExpr("image_id", "n", *rnd("slope", "rho"), *rnd("c_small", "c_mid", n=5))


@query("agg33_dark_knots", "crowd raster", """
  , k as (select j.image_id, j.pid, j.y, j.x from crowd j where nb >= 4),
  n as (select k.pid, min(r.price) as fn from k join raster r on r.image_id = k.image_id and abs(r.y - k.y) <= 1
    and abs(r.x - k.x) <= 1 group by k.pid),
  a as (select k.pid, quantile_cont(r.price, 0.1) as fa, count(*) as n from k join raster r on r.image_id = k.image_id
      and r.value <= 17 and power(r.y - k.y, 2) + power(r.x - k.x, 2) between 9 and 36 group by k.pid having count(*) >= 6)
  select k.image_id, k.pid, a.n, round(fn - fa, 6) as knot from k join n on n.pid = k.pid join a on a.pid = k.pid""")
def agg33(spark, sf):
    """Darkest value at a crowded skeleton pixel against the 10th percentile of the skeleton in a ring around it."""
    from filigrane.operators import relate as J
    r = checkpointed(V.raster(spark, sf))
    k = checkpointed(A.crowding(r.where("value <= 17").select("image_id", "pid", "y", "x")).where("nb >= 4")
                     .select("image_id", "pid", "y", "x"))
    b = J.tag(r.select("image_id", "y", "x", "price", "value"), "b")
    n = J.grid_join(J.tag(k, "a"), b, 2.0, "abs(a_y - b_y) <= 1 and abs(a_x - b_x) <= 1").groupBy(
        "image_id", "a_pid").agg(F.min("b_price").alias("fn"))
    # the ring holds at most about 100 pixels
    a = J.grid_join(J.tag(k, "a"), b, 6.0, f"b_value <= 17 and {J.D2} between 9 and 36").groupBy("image_id", "a_pid").agg(
        F.expr("percentile(b_price, 0.1D)").alias("fa"), F.count(F.lit(1)).alias("n")).where("n >= 6")
    return n.join(a, ["image_id", "a_pid"]).selectExpr("image_id", "a_pid as pid", "n", "round(fn - fa, 6) as knot")


@query("agg34_layout_rates", "crowd", """
  select image_id, round(count(*) filter (nb = 1) / (count(*) / 12.0) * 100, 6) as end_rate,
    round(count(*) filter (nb = 3) / (count(*) / 12.0) * 100, 6) as branch_rate,
    round(count(*) filter (nb >= 4) / (count(*) / 12.0) * 100, 6) as crossing_rate,
    round(count(*) filter (nb >= 4) / greatest(count(*) filter (nb >= 3), 1), 6) as crossing_share
  from crowd group by image_id""")
def agg34(spark, sf):
    c = A.crowding(checkpointed(V.skeleton(spark, sf))).groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"), F.expr("count_if(nb = 1)").alias("e"), F.expr("count_if(nb = 3)").alias("b"),
        F.expr("count_if(nb >= 4)").alias("k"))
    return c.selectExpr("image_id", "round(e / (n / 12.0D) * 100, 6) as end_rate",
                        "round(b / (n / 12.0D) * 100, 6) as branch_rate",
                        "round(k / (n / 12.0D) * 100, 6) as crossing_rate",
                        "round(k / greatest(b + k, 1), 6) as crossing_share")


@query("agg34_long_path_share", "samples", """
  , p as (select image_id, y, x, max(n) as best from samples s join (select vid, max(s_px) as n from samples group by vid) l
    on l.vid = s.vid group by image_id, y, x)
  select image_id, count(*) as n, round(avg((best >= 60)::int), 6) as share_5, round(avg((best >= 72)::int), 6) as share_6
  from p group by image_id""")
def agg34_share(spark, sf):
    """Every pixel takes the longest path through it; shares on paths of 5 and 6 lambda."""
    s = V.samples(spark, sf)
    l = s.groupBy("vid").agg(F.max("s_px").alias("n"))
    p = s.join(l, "vid").groupBy("image_id", "y", "x").agg(F.max("n").alias("best"))
    return p.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"),
                                     F.expr("round(avg(cast(best >= 60 as int)), 6)").alias("share_5"),
                                     F.expr("round(avg(cast(best >= 72 as int)), 6)").alias("share_6"))


@query("agg35_tile_coherence", "skeleton", """
  select image_id, round(sum(z * n) / sum(n), 6) as coherence, count(*) as n_tiles from (
    select image_id, sqrt(power(avg(cos(2 * radians((pid * 37) % 180))), 2) + power(avg(sin(2 * radians((pid * 37) % 180))),
      2)) as z, count(*) as n from skeleton group by image_id, y // 10, x // 10 having count(*) >= 20) group by image_id""")
def agg35(spark, sf):
    t = V.skeleton(spark, sf).groupBy("image_id", F.expr("y div 10"), F.expr("x div 10")).agg(
        F.expr("sqrt(power(avg(cos(2 * radians((pid * 37) % 180))), 2) + power(avg(sin(2 * radians((pid * 37) % 180))), 2))")
        .alias("z"), F.count(F.lit(1)).alias("n")).where("n >= 20")
    return t.groupBy("image_id").agg(F.expr("round(sum(z * n) / sum(n), 6)").alias("coherence"),
                                     F.count(F.lit(1)).alias("n_tiles"))


@query("agg37_pair_fractions", "profiles", """
  select image_id, round(case when count(*) filter (fwhm <= 25) >= 50 then avg((g >= 2)::int) filter (fwhm <= 25) end, 6) as
    pair, round(case when count(*) filter (fwhm <= 25) >= 50 then avg((g >= 3)::int) filter (fwhm <= 25) end, 6) as bundle,
    round(case when count(*) filter (fwhm >= 40) >= 20 then avg((g >= 2)::int) filter (fwhm >= 40) end, 6) as pair_wide
  from (select *, cast(edge as bigint) % 4 as g from profiles) group by image_id""")
def agg37(spark, sf):
    """Shares of thin and wide points in groups of parallel lines; undefined with too few of them."""
    p = V.profiles(spark, sf).withColumn("g", F.expr("cast(edge as bigint) % 4"))

    def part(cond, hit, n):
        return F.expr(f"round(case when count_if({cond}) >= {n} then avg(case when {cond} then cast({hit} as int) end) end,"
                      f" 6)")
    return p.groupBy("image_id").agg(part("fwhm <= 25", "g >= 2", 50).alias("pair"),
                                     part("fwhm <= 25", "g >= 3", 50).alias("bundle"),
                                     part("fwhm >= 40", "g >= 2", 20).alias("pair_wide"))


oracle.define("ratios", ("pixels",), """
  select a.image_id, b.value / a.value as r from pixels a join pixels b on b.image_id = a.image_id + 1 and b.y = a.y
    and b.x = a.x where a.value < -0.06""")


@query("agg38_frame_ratio", "ratios", """
  select image_id, count(*) as n, round(avg((r < 0.3)::int), 6) as dropped, round(avg((r < 0.6)::int), 6) as weak,
    round(1.4826 * median(abs(r - m)) / greatest(any_value(m), 1e-6), 4) as r_cv from (
    select *, median(r) over (partition by image_id) as m from ratios) group by image_id""")
def agg38(spark, sf):
    """A frame (the next image) over its average on the dark pixels."""
    p = V.pixels(spark, sf)
    b = p.selectExpr("image_id - 1 as image_id", "y", "x", "value as f")
    r = checkpointed(p.where("value < -0.06D").join(b, ["image_id", "y", "x"]).selectExpr("image_id", "f / value as r"))
    g = r.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.expr("avg(cast(r < 0.3D as int))").alias("dropped"),
                                  F.expr("avg(cast(r < 0.6D as int))").alias("weak"))
    m = median_abs_dev(r, ["image_id"], "r")
    return g.join(m, "image_id").selectExpr("image_id", "n", *rnd("dropped", "weak"),
                                            "round(1.4826D * mad / greatest(med, 1e-6D), 4) as r_cv")


@query("agg39_faint_gaps", "samples", """
  , f as (select *, peak between 0.02 and 0.9 as sel, peak < 0.3 as absent from samples),
  r as (select *, i - row_number() over (partition by vid, sel order by i) as g from f),
  k as (select vid, g, min(i) as lo, max(i) as hi, count(*) as n from r where sel group by vid, g having count(*) >= 12),
  s as (select k.vid, k.lo, k.hi, f.i, i - row_number() over (partition by k.vid, k.lo, absent order by i) as g2, absent
    from k join f on f.vid = k.vid and f.i between k.lo and k.hi),
  a as (select vid, lo, min(i) as a0, max(i) as a1 from s where absent group by vid, lo, hi, g2
    having count(*) >= 3 and min(i) > lo and max(i) < hi)
  select l.image_id, l.len as n_px, coalesce(g.n, 0) as n_gap, round(coalesce(g.n, 0) / (l.len / 12.0) * 100, 6) as rate
  from (select vid // 25 as image_id, cast(sum(n) as bigint) as len from k group by 1) l
  left join (select vid // 25 as image_id, count(*) as n from a group by 1) g on g.image_id = l.image_id""")
def agg39(spark, sf):
    """Runs of faint samples of at least 12 px and the gaps inside them, per 100 lambda."""
    f = checkpointed(V.samples(spark, sf).selectExpr("image_id", "vid", "i", "peak between 0.02 and 0.9 as sel",
                                                     "peak < 0.3 as absent"))
    d = R.with_stretch(f, R.EDGE, "sel")
    k = checkpointed(d.where("sel").groupBy(*R.EDGE, "_gap").agg(F.min("i").alias("lo"), F.max("i").alias("hi"),
                                                               F.count(F.lit(1)).alias("n")).where("n >= 12"))
    inside = checkpointed(d.where("sel").join(k.select(*R.EDGE, "_gap", "lo", "hi"), [*R.EDGE, "_gap"]).drop("_gap"))
    a = R.islands(inside, [*R.EDGE, "lo", "hi"], "absent").where("n >= 3 and run_start > lo and run_end < hi")
    g = a.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_gap"))
    l = k.groupBy("image_id").agg(F.sum("n").alias("n_px"))
    return l.join(g, "image_id", "left").na.fill(0, ["n_gap"]).withColumn(
        "rate", F.expr("round(n_gap / (n_px / 12.0D) * 100, 6)"))


@query("agg40_paired_fits", "profiles", """
  select image_id, n, round(sign(dv) * sqrt(abs(dv)), 6) as sigma_extra, round(ratio, 6) as ratio, round(sharper, 6) as sharper
  from (select image_id, count(*) as n, median(power(sharp / 5, 2) - power(edge / 3, 2)) as dv,
    median((sharp / 5) / (edge / 3)) as ratio, avg((sharp / 5 > edge / 3)::int) as sharper from profiles group by image_id)
  where n >= 20""")
def agg40(spark, sf):
    """Two fits of one site: signed root of the median variance difference, median ratio, share where one is sharper."""
    p = checkpointed(V.profiles(spark, sf).selectExpr("image_id", "sharp / 5 as a", "edge / 3 as b"))
    v = quantiles(p, ["image_id"], "power(a, 2) - power(b, 2)", {"dv": 0.5}, count="n").where("n >= 20")
    r = quantiles(p, ["image_id"], "a / b", {"ratio": 0.5})
    s = p.groupBy("image_id").agg(F.expr("avg(cast(a > b as int))").alias("sharper"))
    return v.join(r, "image_id").join(s, "image_id").selectExpr(
        "image_id", "n", "round(sign(dv) * sqrt(abs(dv)), 6) as sigma_extra", *rnd("ratio", "sharper"))


@query("agg41_paired_ratios", "profiles", """
  select image_id, case when fwhm < 25 then 'thin' else 'med' end as width_class, count(*) as n,
    round(case when count(*) >= 20 then median((1 - l_discount) * (1 - l_tax)) end, 6) as ratio,
    round(avg(((1 - l_discount) * (1 - l_tax) >= 0.9)::int), 6) as seen from profiles group by 1, 2""")
def agg41(spark, sf):
    p = V.profiles(spark, sf).selectExpr("image_id", "case when fwhm < 25 then 'thin' else 'med' end as width_class",
                                         "(1 - l_discount) * (1 - l_tax) as rd")
    k = ["image_id", "width_class"]
    q = quantiles(p, k, "rd", {"m": 0.5}, count="n")
    s = p.groupBy(*k).agg(F.expr("round(avg(cast(rd >= 0.9D as int)), 6)").alias("seen"))
    return q.join(s, k).selectExpr(*k, "n", "round(case when n >= 20 then m end, 6) as ratio", "seen")


oracle.define("sections", (), """
  select vec_id, label, cast(t as bigint) as t, cast(embedding[t + 1] as double) as v from (
    select *, unnest(range(len(embedding))) as t from embeddings)""")


@query("agg44_median_section", "sections", """
  , c as (select vec_id, arg_min(t, {'v': v, 't': t}) as c from sections where t between 24 and 40 group by vec_id),
  m as (select label, t - c as t, median(v) as m from sections s join c on c.vec_id = s.vec_id
    where t - c between -20 and 20 group by label, t - c),
  b as (select label, median(m) as base from m where abs(t) >= 15 group by label),
  d as (select m.label, t, m - base as d from m join b on b.label = m.label),
  e as (select label, min(d) as dep from d group by label)
  select d.label, round(any_value(dep), 6) as depth, cast(max(t) filter (d <= 0.5 * dep) - min(t) filter (d <= 0.5 * dep)
    as bigint) as fwhm, count(*) as n from d join e on e.label = d.label group by d.label""")
def agg44(spark, sf):
    """Sections re-centred on their darkest point, their pointwise median, its depth and width."""
    s = checkpointed(V.table(spark, sf, "embeddings").selectExpr("vec_id", "label", "posexplode(embedding) as (t, e)")
                     .selectExpr("vec_id", "label", "cast(t as bigint) as t", "cast(e as double) as v"))
    c = s.where("t between 24 and 40").groupBy("vec_id").agg(F.expr("min(struct(v, t)).t").alias("c"))
    r = s.join(c, "vec_id").selectExpr("label", "t - c as t", "v").where("t between -20 and 20")
    m = checkpointed(quantiles(r, ["label", "t"], "v", {"m": 0.5}))
    # at most 41 positions per label from here on
    b = m.where("abs(t) >= 15").groupBy("label").agg(F.expr("percentile(m, 0.5D)").alias("base"))
    d = m.join(b, "label").selectExpr("label", "t", "m - base as d")
    e = d.groupBy("label").agg(F.min("d").alias("dep"))
    return d.join(e, "label").groupBy("label").agg(
        F.expr("round(first(dep), 6)").alias("depth"),
        F.expr("max(case when d <= 0.5D * dep then t end) - min(case when d <= 0.5D * dep then t end)").alias("fwhm"),
        F.count(F.lit(1)).alias("n"))


oracle.define("shifted", ("pixels",), """
  , fr as (select p.*, e.label as burst, (e.vec_id % 3) / 2.0 as dx, (e.vec_id % 5) / 4.0 as dy, e.vec_id % 2 as half,
    p.value > 0.3 as glare from pixels p join embeddings e on e.vec_id = p.image_id),
  g as (select *, exists (select 1 from fr q where q.image_id = f.image_id and q.glare and abs(q.y - f.y) <= 1
    and abs(q.x - f.x) <= 1) as bad from fr f),
  t as (select a.image_id, a.burst, a.half, a.y, a.x, sum(w * coalesce(b.value + 1, 0)) as v,
      sum(w * case when b.bad is null or b.bad then 0 else 1 end) as s from (
      select f.*, cast(floor(f.y + f.dy) as bigint) + cy as sy, cast(floor(f.x + f.dx) as bigint) + cx as sx,
        (case when cy = 1 then f.dy - floor(f.dy) else 1 - (f.dy - floor(f.dy)) end)
        * (case when cx = 1 then f.dx - floor(f.dx) else 1 - (f.dx - floor(f.dx)) end) as w
      from fr f cross join (values (0, 0), (0, 1), (1, 0), (1, 1)) k(cy, cx)) a
    left join g b on b.image_id = a.image_id and b.y = a.sy and b.x = a.sx
    group by a.image_id, a.burst, a.half, a.y, a.x)
  select * from t""")
oracle.VIEWS["shifted"] = (("pixels",), "with " + oracle.VIEWS["shifted"][1].strip()[1:])
oracle.define("burst_mean", ("shifted",), """
  select burst, y, x, sum(v) filter (s >= 0.5 and half = 0) as sa, count(*) filter (s >= 0.5 and half = 0) as ca,
    sum(v) filter (s >= 0.5 and half = 1) as sb, count(*) filter (s >= 0.5 and half = 1) as cb, count(*) as n
  from shifted group by burst, y, x""")


def _frames(spark, sf):
    e = V.table(spark, sf, "embeddings").selectExpr("vec_id as image_id", "label as burst", "(vec_id % 3) / 2.0D as dx",
                                                    "(vec_id % 5) / 4.0D as dy", "vec_id % 2 as half")
    return V.pixels(spark, sf).join(e, "image_id").withColumn("value", F.expr("value + 1"))


def burst_mean(frames, saturated: str):
    """Sums and counts of a burst's frames moved back by their shifts, in two interleaved halves; saturated pixels and
    their neighbours do not count."""
    f = checkpointed(frames)
    bad = A.dilate(f.where(saturated)).withColumn("bad", F.lit(True))
    src = f.join(bad, ["image_id", "y", "x"], "left").selectExpr(
        "image_id", "y", "x", "value", "case when bad is null then 1.0D else 0.0D end as good")
    sites = f.selectExpr("image_id", "burst", "half", "y", "x", "y + dy as py", "x + dx as px")
    k = ["burst", "half", "y", "x"]
    corner = sites.withColumn("c", F.explode(F.expr(
        "array(struct(0L as dy, 0L as dx), struct(0L as dy, 1L as dx), struct(1L as dy, 0L as dx), "
        "struct(1L as dy, 1L as dx))"))).selectExpr(
        "image_id", *k, "cast(floor(py) as long) + c.dy as _y", "cast(floor(px) as long) + c.dx as _x",
        "(case when c.dy = 1 then py - floor(py) else 1 - (py - floor(py)) end) "
        "* (case when c.dx = 1 then px - floor(px) else 1 - (px - floor(px)) end) as w")
    v = corner.join(src.selectExpr("image_id", "y as _y", "x as _x", "value", "good"), ["image_id", "_y", "_x"], "left")
    moved = v.groupBy("image_id", *k).agg(F.expr("sum(w * coalesce(value, 0.0D))").alias("v"),
                                          F.expr("sum(w * coalesce(good, 0.0D))").alias("s"))
    agg = []
    for h, n in ((0, "a"), (1, "b")):
        agg += [F.expr(f"sum(case when s >= 0.5 and half = {h} then v end)").alias(f"s{n}"),
                F.expr(f"count_if(s >= 0.5 and half = {h})").alias(f"c{n}")]
    return moved.groupBy("burst", "y", "x").agg(*agg, F.count(F.lit(1)).alias("n"))


@query("agg46_burst_halves", "burst_mean", """
  select burst, y, x, ca + cb as cover, round(case when ca + cb >= 0.5 * n then (coalesce(sa, 0) + coalesce(sb, 0))
    / (ca + cb) end, 6) as mean, round(case when ca + cb >= 0.5 * n and ca > 0.2 * n and cb > 0.2 * n then
    (ln(sa / ca) - ln(sb / cb)) / 2 * sqrt(4.0 * ca * cb / power(ca + cb, 2)) end, 6) as half_diff from burst_mean""")
def agg46(spark, sf):
    """Burst average where at least half of the frames saw the pixel, and the scaled half difference of two halves."""
    m = burst_mean(_frames(spark, sf), "value > 1.3D")
    return m.selectExpr(
        "burst", "y", "x", "ca + cb as cover",
        "round(case when ca + cb >= 0.5D * n then (coalesce(sa, 0) + coalesce(sb, 0)) / (ca + cb) end, 6) as mean",
        "round(case when ca + cb >= 0.5D * n and ca > 0.2D * n and cb > 0.2D * n then (ln(sa / ca) - ln(sb / cb)) / 2 "
        "* sqrt(4.0D * ca * cb / power(ca + cb, 2)) end, 6) as half_diff")


@query("agg47_camera_pattern", "burst_mean pixels", """
  , mean as (select burst, y, x, (coalesce(sa, 0) + coalesce(sb, 0)) / (ca + cb) as m from burst_mean
    where ca + cb >= 0.5 * n),
  f as (select p.*, e.label as burst, (e.vec_id % 3) / 2.0 as dx, (e.vec_id % 5) / 4.0 as dy from pixels p
    join embeddings e on e.vec_id = p.image_id),
  b as (select f.image_id, f.burst, f.y, f.x, any_value(f.value) + 1 as v, sum(w * m.m) as back, count(m.m) as c from (
      select f.*, cast(floor(f.y - f.dy) as bigint) + cy as sy, cast(floor(f.x - f.dx) as bigint) + cx as sx,
        (case when cy = 1 then (f.y - f.dy) - floor(f.y - f.dy) else 1 - ((f.y - f.dy) - floor(f.y - f.dy)) end)
        * (case when cx = 1 then (f.x - f.dx) - floor(f.x - f.dx) else 1 - ((f.x - f.dx) - floor(f.x - f.dx)) end) as w
      from f cross join (values (0, 0), (0, 1), (1, 0), (1, 1)) k(cy, cx)) f
    join mean m on m.burst = f.burst and m.y = f.sy and m.x = f.sx group by f.image_id, f.burst, f.y, f.x having count(*) = 4),
  n as (select label as burst, count(*) as n from embeddings group by label),
  p as (select b.burst, y, x, avg(v - back) as p from b join n on n.burst = b.burst where v < 1.29 group by b.burst, y, x, n.n
    having count(*) > 0.4 * n.n)
  select burst, count(*) as n_px, round(stddev_pop(p), 6) as sd, round((select stddev_pop(r) from (select median(p) as r
    from p q where q.burst = p.burst group by q.y)), 6) as row_sd from p group by burst""")
def agg47(spark, sf):
    """What stays with the camera: mean residual of the frames against the average moved to each frame; spread over
    pixels and over row medians."""
    f = checkpointed(_frames(spark, sf))
    m = burst_mean(f, "value > 1.3D").where("ca + cb >= 0.5D * n").selectExpr(
        "burst as image_id", "y", "x", "(coalesce(sa, 0) + coalesce(sb, 0)) / (ca + cb) as value")
    sites = f.selectExpr("burst as image_id", "image_id as frame", "y", "x", "value as v", "y - dy as py", "x - dx as px")
    back = bilinear(sites, checkpointed(m), ["frame", "y", "x"]).where("n = 4").drop("n")
    n = f.select("burst", "image_id").distinct().groupBy(F.col("burst").alias("image_id")).agg(
        F.count(F.lit(1)).alias("nf"))
    r = back.join(sites.select("image_id", "frame", "y", "x", "v"), ["image_id", "frame", "y", "x"]).where("v < 1.29D")
    p = r.groupBy("image_id", "y", "x").agg(F.expr("avg(v - value)").alias("p"), F.count(F.lit(1)).alias("c"))
    p = checkpointed(p.join(n, "image_id").where("c > 0.4D * nf"))
    # rows are as long as a frame is wide
    rows = p.groupBy("image_id", "y").agg(F.expr("percentile(p, 0.5D)").alias("r")).groupBy("image_id").agg(
        F.expr("round(stddev_pop(r), 6)").alias("row_sd"))
    return p.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_px"), F.expr("round(stddev_pop(p), 6)").alias("sd")).join(
        rows, "image_id").withColumnRenamed("image_id", "burst")


oracle.define("lap", ("pixels",), f"""
  select p.image_id, p.y, p.x, any_value(p.value) as value, sum(q.value) - 4 * any_value(p.value) as lap from pixels p
    cross join (values (0, 1), (0, -1), (1, 0), (-1, 0)) k(dy, dx) join pixels q on q.image_id = p.image_id
    and q.y = {refl('p.y + k.dy', 8)} and q.x = {refl('p.x + k.dx', 8)} group by p.image_id, p.y, p.x""")


@query("agg48_photon_transfer", "lap", """
  , m as (select *, median(lap) over (partition by image_id, y // 4, x // 4) as ml from lap),
  b as (select image_id, y // 4 as by, x // 4 as bx, avg(value) + 1 as m, power(1.4826 * median(abs(lap - ml)) / sqrt(20), 2)
    as v from m group by 1, 2, 3),
  q as (select quantile_cont(m, [0.02, 0.18, 0.34, 0.5, 0.66, 0.82, 0.98]) as e from b),
  c as (select m, v, (m >= e[1])::int + (m >= e[2])::int + (m >= e[3])::int + (m >= e[4])::int + (m >= e[5])::int
    + (m >= e[6])::int + (m >= e[7])::int as k from b, q),
  p as (select median(m) as x, median(v) as y, count(*) as n from c where k between 1 and 6 group by k having count(*) > 20)
  select round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept, cast(sum(n) as bigint) as n from p""")
def agg48(spark, sf):
    """Noise against level: robust variance per block, medians per quantile bin of the level, a line through them."""
    l = A.laplacian(V.pixels(spark, sf), "value", "8", "8").selectExpr("image_id", "y div 4 as by", "x div 4 as bx",
                                                                       "value", "lap")
    k = ["image_id", "by", "bx"]
    # a block has 16 pixels
    b = l.groupBy(*k).agg(F.expr("avg(value) + 1").alias("m"), F.expr("percentile(lap, 0.5D)").alias("ml"),
                          F.collect_list("lap").alias("ls"))
    b = b.selectExpr("m", "explode(transform(ls, v -> abs(v - ml))) as d", *k).groupBy(*k, "m").agg(
        F.expr("power(1.4826D * percentile(d, 0.5D) / sqrt(20.0D), 2)").alias("v"))
    b = checkpointed(b.withColumn("all", F.lit(1)))
    e = quantiles(b, ["all"], "m", {f"e{j}": 0.02 + 0.16 * j for j in range(7)})
    c = b.join(F.broadcast(e), "all").withColumn("k", F.expr(" + ".join(f"cast(m >= e{j} as int)" for j in range(7))))
    c = checkpointed(c.where("k between 1 and 6").select("k", "m", "v"))
    p = quantiles(c, ["k"], "m", {"x": 0.5}, count="n").where("n > 20").join(quantiles(c, ["k"], "v", {"y": 0.5}), "k")
    return p.agg(F.expr("round(regr_slope(y, x), 6)").alias("slope"),
                 F.expr("round(regr_intercept(y, x), 6)").alias("intercept"), F.sum("n").alias("n"))


@query("agg48_flicker", "", """
  , f as (select label, vec_id, list_avg(embedding) + 1 as m from embeddings),
  r as (select label, (m - lag(m) over (partition by label order by vec_id)) / lag(m) over (partition by label
    order by vec_id) as r from f)
  select label, count(r) as n, round(1.4826 * median(abs(r - k)) / sqrt(2), 6) as flicker from (
    select *, median(r) over (partition by label) as k from r where r is not null) group by label""")
def agg48_flicker(spark, sf):
    """Change of the frame mean from one frame of a burst to the next, robustly."""
    from filigrane.operators.scan import running
    f = V.table(spark, sf, "embeddings").selectExpr(
        "label", "vec_id", "aggregate(embedding, 0.0D, (a, v) -> a + v, a -> a / size(embedding)) + 1 as m",
        "vec_id div 4096 as _ck")
    d = running(f, ["label"], ["vec_id"], "_ck", {"p": ("last", "m")}, exclusive=("p",))
    d = checkpointed(d.where("p is not null").selectExpr("label", "(m - p) / p as r"))
    n = d.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.join(median_abs_dev(d, ["label"], "r"), "label").selectExpr(
        "label", "n", "round(1.4826D * mad / sqrt(2.0D), 6) as flicker")


@query("agg49_band_texture", "dog", """
  , m as (select *, median(v) over (partition by image_id) as md, avg(v) over (partition by image_id) as mu,
    stddev_pop(v) over (partition by image_id) as sd from dog)
  select image_id, round(any_value(sd), 6) as rms, round(sqrt(avg(power(v - md, 2)) filter (v > md)), 6) as rms_bright,
    round(avg(power(v - mu, 4)) / power(any_value(sd), 4) - 3, 5) as kurt,
    round(avg(power(v - mu, 3)) / power(any_value(sd), 3), 5) as skew,
    round(avg((v < mu - 2 * sd)::int), 6) as tail_lo, round(avg((v > mu + 2 * sd)::int), 6) as tail_hi,
    round((select stddev_pop(r) / avg(r) from (select stddev_pop(d.v) as r from dog d where d.image_id = m.image_id
      group by d.y // 4, d.x // 4)), 6) as local_cv from m group by image_id""")
def agg49(spark, sf):
    d = checkpointed(A.difference_of_gaussians(V.pixels(spark, sf), "value", 1.0, "8", "8", "v"))
    q = quantiles(d, ["image_id"], "v", {"md": 0.5})
    g = d.groupBy("image_id").agg(F.avg("v").alias("mu"), F.expr("stddev_pop(v)").alias("sd"),
                                  F.expr("kurtosis(v)").alias("kurt"), F.expr("skewness(v)").alias("skew"))
    s = q.join(g, "image_id")
    b = d.join(s.select("image_id", "md", "mu", "sd"), "image_id").groupBy("image_id").agg(
        F.expr("round(sqrt(avg(case when v > md then power(v - md, 2) end)), 6)").alias("rms_bright"),
        F.expr("round(avg(cast(v < mu - 2 * sd as int)), 6)").alias("tail_lo"),
        F.expr("round(avg(cast(v > mu + 2 * sd as int)), 6)").alias("tail_hi"))
    t = d.groupBy("image_id", F.expr("y div 4"), F.expr("x div 4")).agg(F.expr("stddev_pop(v)").alias("r")).groupBy(
        "image_id").agg(F.expr("round(stddev_pop(r) / avg(r), 6)").alias("local_cv"))
    return s.join(b, "image_id").join(t, "image_id").selectExpr(
        "image_id", "round(sd, 6) as rms", "rms_bright", *rnd("kurt", "skew", n=5), "tail_lo", "tail_hi", "local_cv")


@query("agg51_noise_model", "lap", """
  , q as (select quantile_cont(value, [0.02, 0.14, 0.26, 0.38, 0.5, 0.62, 0.74, 0.86, 0.98]) as e from lap),
  c as (select value, lap, """ + " + ".join(f"(value >= e[{j}])::int" for j in range(1, 10)) + """ as k from lap, q),
  m as (select *, median(lap) over (partition by k) as ml from c where k between 1 and 8),
  p as (select k, median(value) as x, power(1.4826 * median(abs(lap - ml)), 2) / 20 as y from m group by k
    having count(*) >= 200)
  select cast(k as bigint) as bin, round(x, 6) as level, round(y, 6) as variance from p""")
def agg51(spark, sf):
    b = _noise_bins(spark, sf)
    return b.selectExpr("cast(k as bigint) as bin", "round(x, 6) as level", "round(y, 6) as variance")


def _noise_bins(spark, sf):
    """Robust noise variance per quantile bin of the level."""
    l = A.laplacian(V.pixels(spark, sf), "value", "8", "8").withColumn("all", F.lit(1))
    l = checkpointed(l.select("all", "value", "lap"))
    e = quantiles(l, ["all"], "value", {f"e{j}": 0.02 + 0.12 * j for j in range(9)})
    c = l.join(F.broadcast(e), "all").withColumn("k", F.expr(" + ".join(f"cast(value >= e{j} as int)" for j in range(9))))
    c = checkpointed(c.where("k between 1 and 8").select("k", "value", "lap"))
    m = median_abs_dev(c, ["k"], "lap")
    x = quantiles(c, ["k"], "value", {"x": 0.5}, count="n").where("n >= 200")
    return x.join(m, "k").selectExpr("k", "x", "power(1.4826D * mad, 2) / 20 as y")


@query("agg51_noise_fit", "lap", """
  , q as (select quantile_cont(value, [0.02, 0.14, 0.26, 0.38, 0.5, 0.62, 0.74, 0.86, 0.98]) as e from lap),
  c as (select value, lap, len(list_filter(e, lambda b: value >= b)) as k from lap, q),
  m as (select *, median(lap) over (partition by k) as ml from c where k between 1 and 8),
  p as (select median(value) as x, power(1.4826 * median(abs(lap - ml)), 2) / 20 as y from m group by k having count(*) >= 200),
  a as (select regr_slope(x * x, x) as b1, regr_intercept(x * x, x) as b0, regr_slope(y, x) as d1, regr_intercept(y, x) as d0 from p),
  f as (select any_value(b0) as b0, any_value(b1) as b1, any_value(d0) as d0, any_value(d1) as d1,
    sum((y - d0 - d1 * x) * (x * x - b0 - b1 * x)) / sum(power(x * x - b0 - b1 * x, 2)) as c2 from p, a)
  select round(d0 - c2 * b0, 6) as c0, round(d1 - c2 * b1, 6) as c1, round(c2, 6) as c2 from f""")
def agg51_fit(spark, sf):
    """Quadratic through the bins by normal equations: seven sums, then a 3 x 3 solve in expressions."""
    return quadratic_fit(_noise_bins(spark, sf), "x", "y").selectExpr(*[f"round({c}, 6) as {c}" for c in ("c0", "c1", "c2")])


def quadratic_fit(points, x: str, y: str):
    s = points.selectExpr(*[f"sum(power({x}, {k})) as s{k}" for k in range(5)],
                          *[f"sum({y} * power({x}, {k})) as t{k}" for k in range(3)])
    det = "(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2))"
    return s.selectExpr(
        f"(t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / {det} as c0",
        f"(s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / {det} as c1",
        f"(s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / {det} as c2")
