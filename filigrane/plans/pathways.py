"""Queries measuring along paths, splines and bursts."""
from __future__ import annotations

from pyspark.sql import functions as F

from filigrane.operators import paths as P
from filigrane.operators import spline
from filigrane.operators.quantile import quantiles
from filigrane.operators.scan import CHUNK, halo, own, running
from filigrane.plans import oracle
from filigrane.plans.registry import query
from filigrane.session import checkpointed
from filigrane.sources import views as V

K = ["image_id", "vid"]
oracle.define("arcs", ("samples",), """
  select *, sum(coalesce(sqrt(power(x - px, 2) + power(y - py, 2)), 0)) over (partition by vid order by i) as arc
  from (select *, lag(x) over (partition by vid order by i) as px, lag(y) over (partition by vid order by i) as py
        from samples)""")


@query("path01_arclength", "arcs", "select vid, i, round(arc, 6) as arc from arcs")
def path01(spark, sf):
    return P.arclength(V.samples(spark, sf), K).selectExpr("vid", "i", "round(arc, 6) as arc")


def kernel_values(sigma):
    return ", ".join(f"({o}, {w!r})" for o, w in P.kernel(sigma))


def smooth_sql(src, cols, sigma, part="vid", pos="i"):
    s = ", ".join(f"sum(k.w * b.{c}) as {c}_s" for c in cols)
    return f"""
    select a.{part}, a.{pos}, {s} from (select *, max({pos}) over (partition by {part}) as _n from {src}) a
    cross join (values {kernel_values(sigma)}) k(o, w)
    join {src} b on b.{part} = a.{part} and b.{pos} = least(greatest(a.{pos} + k.o, 0), a._n) group by a.{part}, a.{pos}"""


@query("ker01_smooth_along_path", "samples", ", s as (" + smooth_sql("samples", ["peak"], 2.0) + """)
  select vid, i, round(peak_s, 6) as value from s""")
def ker01(spark, sf):
    return P.smooth(V.samples(spark, sf).select(*K, "i", "peak"), K, ["peak"], 2.0).selectExpr(
        "vid", "i", "round(peak_s, 6) as value")


@query("path02_resample", "samples", ", s as (" + smooth_sql("samples", ["x", "y"], 1.5) + """),
  a as (select *, sum(coalesce(sqrt(power(x_s - px, 2) + power(y_s - py, 2)), 0)) over (partition by vid order by i) as arc
    from (select *, lag(x_s) over (partition by vid order by i) px, lag(y_s) over (partition by vid order by i) py from s)),
  g as (select *, lead(arc) over (partition by vid order by i) a1, lead(x_s) over (partition by vid order by i) x1,
      lead(y_s) over (partition by vid order by i) y1 from a)
  select vid, cast(k as bigint) as k, round(x_s + (k - arc) / (a1 - arc) * (x1 - x_s), 5) as x,
    round(y_s + (k - arc) / (a1 - arc) * (y1 - y_s), 5) as y
  from (select *, unnest(generate_series(cast(ceil(arc) as bigint), cast(ceil(a1) as bigint) - 1)) as k from g
        where a1 > arc)""")
def path02(spark, sf):
    s = P.smooth(V.samples(spark, sf).select(*K, "i", "x", "y"), K, ["x", "y"], 1.5).selectExpr(
        *K, "i", "x_s as x", "y_s as y")
    a = checkpointed(P.arclength(checkpointed(s), K))
    return P.resample(a, K, 1.0).selectExpr("vid", "cast(k as bigint) as k", "round(x, 5) as x", "round(y, 5) as y")


BERN = ["power(1 - t, 3)", "3 * t * power(1 - t, 2)", "3 * t * t * (1 - t)", "t * t * t"]
D1 = ["-3 * power(1 - t, 2)", "3 * power(1 - t, 2) - 6 * t * (1 - t)", "6 * t * (1 - t) - 3 * t * t", "3 * t * t"]
DD = ["6 * (1 - t)", "6 * (3 * t - 2)", "6 * (1 - 3 * t)", "6 * t"]


def _bez(coef, ax):
    return " + ".join(f"({c}) * ctrl[{j + 1}].{ax}" for j, c in enumerate(coef))


@query("path03_spline_samples", "with_ctrl", f""",
  s as (select vid, q, {_bez(BERN, 'x')} as x, {_bez(BERN, 'y')} as y, {_bez(D1, 'x')} as x1, {_bez(D1, 'y')} as y1,
      {_bez(DD, 'x')} as x2, {_bez(DD, 'y')} as y2, power(1 - t, 2) * r_ctrl[1] + 2 * t * (1 - t) * r_ctrl[2]
      + t * t * r_ctrl[3] as r
    from (select *, q / 8.0 as t from (select *, unnest(range(9)) as q from with_ctrl)))
  select vid, round(sum(sqrt(power(x - px, 2) + power(y - py, 2))), 5) as chords, round(avg(r), 9) as mean_r,
    round(max(abs(x1 * y2 - y1 * x2) / power(greatest(sqrt(x1 * x1 + y1 * y1), 1e-12), 3)), 5) as max_kappa
  from (select *, lag(x) over (partition by vid order by q) px, lag(y) over (partition by vid order by q) py from s)
  group by vid""")
def path03(spark, sf):
    """Curves, tangents, curvature and radius at nine parameters, summed up per edge (nine rows each)."""
    e = checkpointed(V.with_ctrl(spark, sf).select("vid", "ctrl", "r_ctrl"))
    c = spline.sample_curves(e, 8, profiles={"r": "r_ctrl"})
    return c.groupBy("vid").agg(
        F.expr("round(sum(sqrt(power(x - px, 2) + power(y - py, 2))), 5)").alias("chords"),
        F.expr("round(avg(r), 9)").alias("mean_r"), F.expr("round(max(abs(kappa)), 5)").alias("max_kappa"))


@query("path04_edge_means", "samples", """
  select vid, max(s_px) as length, round(avg(peak), 6) as mean_peak, min(peak) as min_peak, max(peak) as max_peak,
    avg(r) as mean_r, avg(z) as mean_z from samples group by vid""")
def path04(spark, sf):
    return V.samples(spark, sf).groupBy("vid").agg(
        F.max("s_px").alias("length"), F.expr("round(avg(peak), 6)").alias("mean_peak"), F.min("peak").alias("min_peak"),
        F.max("peak").alias("max_peak"), F.avg("r").alias("mean_r"), F.avg("z").alias("mean_z"))


@query("path05_tortuosity", "samples", """
  select image_id, m, count(*) as n, round(avg(m / greatest(sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2)), 1e-6)), 4)
    as mean_ratio from (select *, unnest([12, 24, 48]) as m from samples) a join (select vid, i, x, y from samples) b
    on b.vid = a.vid and b.i = a.i + m where a.i % (m // 4) = 0 group by image_id, m""")
def path05(spark, sf):
    """Arc over chord in windows of 1, 2 and 4 lambda, every quarter window."""
    d = P.with_neighbours(V.samples(spark, sf).select(*K, "i", "x", "y"), K, ["x", "y"], [12, 24, 48])
    d = d.selectExpr("image_id", "i", "x", "y", "stack(3, 12L, x_p12, y_p12, 24L, x_p24, y_p24, 48L, x_p48, y_p48) "
                     "as (m, x1, y1)").where("x1 is not null and i % (m div 4) = 0")
    return d.groupBy("image_id", "m").agg(F.count(F.lit(1)).alias("n"), F.expr(
        "round(avg(m / greatest(sqrt(power(x1 - x, 2) + power(y1 - y, 2)), 1e-6D)), 4)").alias("mean_ratio"))


@query("path06_window_majority", "arcs", """,
  a as (select image_id, vid, i, round(arc, 6) as arc, cnr >= 3 as f, max(round(arc, 6)) over (partition by vid) as last
    from arcs)
  select vid, i, f and arc - 10 >= 0 and arc + 10 <= last and avg(f::int) over (partition by vid order by arc
      range between 10 preceding and 10 following) >= 0.5 as majority from a""")
def path06(spark, sf):
    """Flagged, and at least half of the centred 20 px of arc flagged too; windows that leave the path do not count."""
    a = P.arclength(V.samples(spark, sf), K).selectExpr(*K, "i", "round(arc, 6) as arc", "cnr >= 3 as f")
    a = checkpointed(a)
    last = a.groupBy(*K).agg(F.max("arc").alias("last"))
    d = halo(a, 11, "arc")
    d = own(d.withColumn("share", F.expr("avg(cast(f as int)) over (partition by image_id, vid, _c order by arc "
                                         "range between 10.0D preceding and 10.0D following)"))).join(last, K)
    return d.selectExpr("vid", "i", "f and arc - 10 >= 0 and arc + 10 <= last and share >= 0.5 as majority")


@query("path07_elbows", "samples", """
  select a.image_id, count(*) as n, round(avg((degrees(acos(least(greatest(((a.x - p.x) * (q.x - a.x)
      + (a.y - p.y) * (q.y - a.y)) / greatest(sqrt(power(a.x - p.x, 2) + power(a.y - p.y, 2))
      * sqrt(power(q.x - a.x, 2) + power(q.y - a.y, 2)), 1e-9), -1.0), 1.0))) > 20)::int), 6) as elbow_share
  from samples a join samples p on p.vid = a.vid and p.i = a.i - 3 join samples q on q.vid = a.vid and q.i = a.i + 3
  group by a.image_id""")
def path07(spark, sf):
    """Share of points whose heading turns by more than 20 degrees between the 3 px before and after."""
    d = P.with_neighbours(V.samples(spark, sf).select(*K, "i", "x", "y"), K, ["x", "y"], [-3, 3])
    d = d.where("x_m3 is not null and x_p3 is not null").selectExpr(
        "image_id", "x - x_m3 as ax", "y - y_m3 as ay", "x_p3 - x as bx", "y_p3 - y as by")
    ang = ("degrees(acos(least(greatest((ax * bx + ay * by) / greatest(sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by * by)"
           ", 1e-9D), -1.0D), 1.0D)))")
    return d.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"),
                                     F.expr(f"round(avg(cast({ang} > 20 as int)), 6)").alias("elbow_share"))


@query("path08_calibre_change", "samples", ", s as (" + smooth_sql("samples", ["cnr"], 3.0) + """)
  select a.vid // 25 as image_id, count(*) as n, round(median(abs(ln(greatest(b.cnr_s, 1) / greatest(a.cnr_s, 1)))), 6)
    as change from s a join s b on b.vid = a.vid and b.i = a.i + 60 where a.i % 12 = 0 group by 1""")
def path08(spark, sf):
    """Log ratio of the smoothed width (here cnr) five lambda further on, every lambda: median per image."""
    s = checkpointed(P.smooth(V.samples(spark, sf).select(*K, "i", "cnr"), K, ["cnr"], 3.0))
    d = P.with_neighbours(s, K, ["cnr_s"], [60]).where("cnr_s_p60 is not null and i % 12 = 0").withColumn(
        "v", F.expr("abs(ln(greatest(cnr_s_p60, 1) / greatest(cnr_s, 1)))"))
    return quantiles(d, ["image_id"], "v", {"change": 0.5}, count="n").selectExpr(
        "image_id", "n", "round(change, 6) as change")


@query("path09_straightness", "arcs", """
  select image_id, vid, round(sqrt(power(arg_max(x, i) - arg_min(x, i), 2) + power(arg_max(y, i) - arg_min(y, i), 2))
    / greatest(max(arc), 1e-9), 6) as straightness from arcs group by image_id, vid having max(arc) >= 120""")
def path09(spark, sf):
    a = P.arclength(V.samples(spark, sf), K)
    a = a.groupBy(*K).agg(F.expr("min_by(struct(x, y), i)").alias("p"), F.expr("max_by(struct(x, y), i)").alias("q"),
                          F.max("arc").alias("arc")).where("arc >= 120")
    return a.selectExpr(*K, "round(sqrt(power(q.x - p.x, 2) + power(q.y - p.y, 2)) / greatest(arc, 1e-9D), 6) "
                        "as straightness")


@query("path10_running_median", "samples", """
  select a.vid, a.i, median(b.peak) as med from (select *, max(i) over (partition by vid) as n from samples) a
  cross join (values (-2), (-1), (0), (1), (2)) k(o)
  join samples b on b.vid = a.vid and b.i = least(greatest(a.i + k.o, 0), a.n) group by a.vid, a.i""")
def path10(spark, sf):
    d = P.with_neighbours(V.samples(spark, sf).select(*K, "i", "peak"), K, ["peak"], [-2, -1, 1, 2], hold=True)
    return d.selectExpr("vid", "i", "sort_array(array(peak_m2, peak_m1, peak, peak_p1, peak_p2))[2] as med")


def _grad(f, lo, hi):
    hs, hd = f"(time_s - {lo}t)", f"({hi}t - time_s)"
    return (f"case when {lo}t is null then ({hi}{f} - {f}) / {hd} when {hi}t is null then ({f} - {lo}{f}) / {hs} "
            f"else ({hs} * {hs} * {hi}{f} + ({hd} * {hd} - {hs} * {hs}) * {f} - {hd} * {hd} * {lo}{f}) "
            f"/ ({hs} * {hd} * ({hd} + {hs})) end")


@query("path12_eye_speed", "burst_frames", f"""
  select burst, idx, round(1e3 * sqrt(power({_grad('dx_px', 'p_', 'n_')}, 2) + power({_grad('dy_px', 'p_', 'n_')}, 2)), 5)
    as speed
  from (select *, lag(dx_px) over w p_dx_px, lead(dx_px) over w n_dx_px, lag(dy_px) over w p_dy_px,
    lead(dy_px) over w n_dy_px, lag(time_s) over w p_t, lead(time_s) over w n_t from burst_frames
    window w as (partition by burst order by idx))""")
def path12(spark, sf):
    """Speed by central differences over uneven times, in px per 1000 s."""
    b = checkpointed(V.burst_frames(spark, sf).select("burst", "idx", "time_s", "dx_px", "dy_px"))
    d = P.with_neighbours(b, ["burst"], ["dx_px", "dy_px", "time_s"], [-1, 1], "idx")
    d = d.selectExpr("burst", "idx", "time_s", "dx_px", "dy_px", "dx_px_m1 as p_dx_px", "dx_px_p1 as n_dx_px",
                     "dy_px_m1 as p_dy_px", "dy_px_p1 as n_dy_px", "time_s_m1 as p_t", "time_s_p1 as n_t")
    return d.selectExpr("burst", "idx", f"round(1e3D * sqrt(power({_grad('dx_px', 'p_', 'n_')}, 2) "
                        f"+ power({_grad('dy_px', 'p_', 'n_')}, 2)), 5) as speed")


@query("path13_trajectory", "burst_frames", """
  select burst, count(*) as n, round(sqrt(power(stddev_pop(dx_px), 2) + power(stddev_pop(dy_px), 2)) / sqrt(2), 6) as sd,
    round(median(st), 6) as step from (select *, sqrt(power(dx_px - lag(dx_px) over w, 2) + power(dy_px - lag(dy_px)
    over w, 2)) as st from burst_frames where registered window w as (partition by burst order by idx))
  group by burst having count(*) > 2""")
def path13(spark, sf):
    """Spread and median step of the registered frames of a burst."""
    b = V.burst_frames(spark, sf).where("registered").withColumn("_ck", F.expr(f"idx div {CHUNK}"))
    d = running(b, ["burst"], ["idx"], "_ck", {"p": ("last", "struct(dx_px, dy_px)")}, exclusive=("p",), cut=True)
    d = checkpointed(d.withColumn("st", F.expr("sqrt(power(dx_px - p.dx_px, 2) + power(dy_px - p.dy_px, 2))")))
    a = d.groupBy("burst").agg(F.count(F.lit(1)).alias("n"), F.expr(
        "round(sqrt(power(stddev_pop(dx_px), 2) + power(stddev_pop(dy_px), 2)) / sqrt(2.0D), 6)").alias("sd"))
    m = quantiles(d, ["burst"], "st", {"step": 0.5})
    return a.where("n > 2").join(m, "burst").selectExpr("burst", "n", "sd", "round(step, 6) as step")


@query("top06_spread_frames", "burst_frames", """
  select burst, k, idx from (select *, row_number() over (partition by burst order by idx) - 1 as rn,
      count(*) over (partition by burst) as c from burst_frames where registered) f
  join (select unnest(range(8)) as k) q on f.rn = cast(floor((k + 0.5) * c / 8) as bigint)""")
def top06(spark, sf):
    """Eight registered frames spread evenly over every burst."""
    b = V.burst_frames(spark, sf).where("registered").withColumn("_ck", F.expr(f"idx div {CHUNK}"))
    r = running(b, ["burst"], ["idx"], "_ck", {"rn": ("sum", "1L")}, cut=True)
    n = b.groupBy("burst").agg(F.count(F.lit(1)).alias("c")).withColumn("k", F.expr("explode(sequence(0L, 7L))"))
    want = n.selectExpr("burst", "k", "cast(floor((k + 0.5D) * c / 8) as bigint) + 1 as rn")
    return r.join(want, ["burst", "rn"]).select("burst", "k", "idx")


@query("jn15_interpolate", "samples", """,
  w as (select vid, i, peak, max(case when cnr >= 6 then i end) over (partition by vid order by i) as lo,
    min(case when cnr >= 6 then i end) over (partition by vid order by i rows between current row and unbounded following)
    as hi from samples)
  select w.vid, w.i, round(case when lo is null then h.peak when hi is null or hi = lo then l.peak
    else l.peak + (w.i - lo) / (hi - lo) * (h.peak - l.peak) end, 10) as value
  from w left join samples l on l.vid = w.vid and l.i = w.lo left join samples h on h.vid = w.vid and h.i = w.hi""")
def jn15(spark, sf):
    """Values between the samples that stand out, by linear interpolation along the edge, held beyond the ends."""
    s = V.samples(spark, sf)
    c = s.where("cnr >= 6").selectExpr("vid", "i as at", "peak")
    r = P.interpolate(c, s.selectExpr("vid", "i as at", "i"), ["vid"], "at", "peak", "value")
    return r.selectExpr("vid", "i", "round(value, 10) as value")


@query("fn13_unit_normals", "samples", """
  select vid, i, round(-gy / greatest(sqrt(gx * gx + gy * gy), 1e-9), 6) + 0 as nx,
    round(gx / greatest(sqrt(gx * gx + gy * gy), 1e-9), 6) + 0 as ny from (
    select vid, i, case when px is null then qx - x when qx is null then x - px else (qx - px) / 2 end as gx,
      case when py is null then qy - y when qy is null then y - py else (qy - py) / 2 end as gy
    from (select *, lag(x) over w px, lead(x) over w qx, lag(y) over w py, lead(y) over w qy from samples
      window w as (partition by vid order by i)))""")
def fn13(spark, sf):
    d = P.with_neighbours(V.samples(spark, sf).select(*K, "i", "x", "y"), K, ["x", "y"], [-1, 1])
    for a in "xy":
        d = d.withColumn(f"g{a}", F.expr(f"case when {a}_m1 is null then {a}_p1 - {a} when {a}_p1 is null then "
                                         f"{a} - {a}_m1 else ({a}_p1 - {a}_m1) / 2 end"))
    n = "greatest(sqrt(gx * gx + gy * gy), 1e-9D)"
    return d.selectExpr("vid", "i", f"round(-gy / {n}, 6) + 0 as nx", f"round(gx / {n}, 6) + 0 as ny")


@query("agg43_autocovariance", "samples", ", s as (" + smooth_sql("samples", ["peak"], 6.0) + """),
  h as (select a.vid, a.i, a.peak - s.peak_s as d from samples a join s on s.vid = a.vid and s.i = a.i),
  c as (select a.vid // 25 as image_id, b.i - a.i as lag, sum(a.d * b.d) / count(*) as c, count(*) as n from h a join h b
    on b.vid = a.vid and b.i - a.i between 0 and 8 group by 1, 2)
  select image_id, cast(lag as bigint) as lag, n, round(c, 6) as c, round(c / first_value(c) over (partition by image_id
    order by lag), 6) as rho from c""")
def agg43(spark, sf):
    """Autocovariance by lag of the high-passed values along all edges of an image."""
    s = V.samples(spark, sf).select(*K, "i", "peak")
    h = checkpointed(P.smooth(s, K, ["peak"], 6.0).selectExpr(*K, "i", "peak - peak_s as d"))
    d = P.with_neighbours(h, K, ["d"], list(range(1, 9)))
    st = ", ".join(f"{k}L, d{'' if k == 0 else f'_p{k}'}" for k in range(9))
    d = d.selectExpr("image_id", "d", f"stack(9, {st}) as (lag, e)").where("e is not null")
    c = d.groupBy("image_id", "lag").agg(F.expr("sum(d * e) / count(1)").alias("c"), F.count(F.lit(1)).alias("n"))
    c = checkpointed(c)
    z = c.where("lag = 0").selectExpr("image_id", "c as c0")
    return c.join(z, "image_id").selectExpr("image_id", "lag", "n", "round(c, 6) as c", "round(c / c0, 6) as rho")


@query("agg42_grain", "samples", ", s as (" + smooth_sql("samples", ["peak"], 6.0) + """),
  h as (select a.vid, a.i, a.peak - s.peak_s as d, a.contrast - s.peak_s as e from samples a join s on s.vid = a.vid
    and s.i = a.i),
  m as (select vid, 1.4826 * median(abs(d - md)) as rd, 1.4826 * median(abs(e - me)) as re from (
    select *, median(d) over (partition by vid) as md, median(e) over (partition by vid) as me from h) group by vid)
  select vid // 25 as image_id, round(median(rd), 6) as signal, round(median(re), 6) as noise,
    round(sqrt(greatest(power(median(rd), 2) - power(0.5 * median(re), 2), 0)), 6) as grain from m group by 1""")
def agg42(spark, sf):
    """Robust SD of the high-passed values per edge, the median over edges, and a noise part taken off in quadrature."""
    from filigrane.operators.quantile import median_abs_dev
    s = V.samples(spark, sf).select(*K, "i", "peak", "contrast")
    h = checkpointed(P.smooth(s, K, ["peak"], 6.0).selectExpr(*K, "peak - peak_s as d", "contrast - peak_s as e"))
    rd = median_abs_dev(h, K, "d", "rd").drop("med")
    re = median_abs_dev(h, K, "e", "re").drop("med")
    r = checkpointed(rd.join(re, K, "left"))
    q = quantiles(r, ["image_id"], "1.4826D * rd", {"a": 0.5}).join(
        quantiles(r, ["image_id"], "1.4826D * re", {"b": 0.5}), "image_id")
    return q.selectExpr("image_id", "round(a, 6) as signal", "round(b, 6) as noise",
                        "round(sqrt(greatest(a * a - 0.25D * b * b, 0.0D)), 6) as grain")


SEG, FREQ = 32, 17


@query("sta13_path_spectrum", "samples", f""",
  g as (select a.vid, a.i // 16 as s, b.i - a.i as n, b.peak as v from samples a join samples b on b.vid = a.vid
    and b.i - a.i between 0 and 31 where a.i % 16 = 0 and exists (select 1 from samples c where c.vid = a.vid
    and c.i = a.i + 31)),
  r as (select vid, s, regr_slope(v, n) as k, regr_intercept(v, n) as c from g group by vid, s),
  f as (select g.vid, g.s, q.f, sum((v - k * n - c) * (0.5 - 0.5 * cos(2 * pi() * n / 31)) * cos(2 * pi() * q.f * n / 32))
      as re, sum((v - k * n - c) * (0.5 - 0.5 * cos(2 * pi() * n / 31)) * sin(2 * pi() * q.f * n / 32)) as im
    from g join r on r.vid = g.vid and r.s = g.s cross join (select unnest(range(17)) as f) q group by g.vid, g.s, q.f)
  select f, count(*) as n_seg, round(sum(re * re + im * im), 4) as power from f group by f""")
def sta13(spark, sf):
    """Power spectrum of half-overlapping detrended windows along all edges. A sample goes into the (at most two)
    segments that hold it; segments that run past the edge are left out."""
    s = V.samples(spark, sf).select("vid", "i", "peak")
    g = s.withColumn("s", F.explode(F.expr("filter(array(i div 16, i div 16 - 1), k -> k >= 0)"))).selectExpr(
        "vid", "s", "i - 16 * s as n", "peak as v")
    fit = g.groupBy("vid", "s").agg(F.expr("regr_slope(v, n)").alias("k"), F.expr("regr_intercept(v, n)").alias("c"),
                                    F.count(F.lit(1)).alias("m")).where(f"m = {SEG}").drop("m")
    d = g.join(fit, ["vid", "s"]).withColumn("w", F.expr(
        "(v - k * n - c) * (0.5D - 0.5D * cos(2 * pi() * n / 31))")).withColumn(
        "f", F.expr(f"explode(sequence(0L, {FREQ - 1}L))"))
    p = d.groupBy("vid", "s", "f").agg(F.expr("sum(w * cos(2 * pi() * f * n / 32))").alias("re"),
                                       F.expr("sum(w * sin(2 * pi() * f * n / 32))").alias("im"))
    return p.groupBy("f").agg(F.count(F.lit(1)).alias("n_seg"), F.expr("round(sum(re * re + im * im), 4)").alias("power"))
