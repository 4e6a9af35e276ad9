"""Queries over pixels, skeletons and rasters."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from filigrane.operators import continuation as K
from filigrane.operators import distance as D
from filigrane.operators import network as N
from filigrane.operators import raster as A
from filigrane.operators import relate as J
from filigrane.operators.grid import near_positions
from filigrane.operators.paths import kernel
from filigrane.operators.quantile import median_abs_dev, quantiles
from filigrane.operators.scan import spread
from filigrane.operators.scorecard import top_by
from filigrane.plans import oracle
from filigrane.plans import sequences  # noqa: F401  (defines the views of visible samples)
from filigrane.plans.registry import query
from filigrane.session import checkpointed
from filigrane.sources import views as V


def ksql(k):
    return ", ".join(f"({o}, {w!r})" for o, w in k)


def refl(e, n):
    return f"case when {e} < 0 then -1 - ({e}) when {e} >= {n} then {2 * n} - 1 - ({e}) else {e} end"


def conv_sql(src, col, kx, ky, out, n=8):
    """Separable stencil with reflected borders on n x n images, as plain joins."""
    return f"""select h.image_id, h.y, h.x, sum(k.w * g.v) as {out} from {src} h cross join (values {ksql(ky)}) k(o, w)
      join (select p.image_id, p.y, p.x, sum(k.w * q.{col}) as v from {src} p cross join (values {ksql(kx)}) k(o, w)
        join {src} q on q.image_id = p.image_id and q.y = p.y and q.x = {refl('p.x + k.o', n)} group by p.image_id, p.y, p.x)
      g on g.image_id = h.image_id and g.x = h.x and g.y = {refl('h.y + k.o', n)} group by h.image_id, h.y, h.x"""


oracle.define("g1", ("pixels",), conv_sql("pixels", "value", kernel(1.0), kernel(1.0), "v"))
oracle.define("g2", ("pixels",), conv_sql("pixels", "value", kernel(2.0), kernel(2.0), "v"))
oracle.define("dog", ("g1", "g2"), """
  select a.image_id, a.y, a.x, a.v - b.v as v from g1 a join g2 b on b.image_id = a.image_id and b.y = a.y and b.x = a.x""")


@query("ker02_gaussian", "g1", "select image_id, y, x, round(v, 6) as v from g1")
def ker02(spark, sf):
    return A.gaussian(V.pixels(spark, sf), "value", 1.0, "8", "8", "v").selectExpr("image_id", "y", "x",
                                                                                   "round(v, 6) as v")


@query("ker02_band_rms", "dog", """
  select image_id, round(stddev_pop(v), 6) as rms, round(sqrt(avg(v * v)), 6) as rms0 from dog group by image_id""")
def ker02_bands(spark, sf):
    d = A.difference_of_gaussians(V.pixels(spark, sf), "value", 1.0, "8", "8", "v")
    return d.groupBy("image_id").agg(F.expr("round(stddev_pop(v), 6)").alias("rms"),
                                     F.expr("round(sqrt(avg(v * v)), 6)").alias("rms0"))


@query("ker08_robust_band_rms", "dog", """
  select image_id, round(1.4826 * median(abs(v - m)), 6) as rms from (
    select *, median(v) over (partition by image_id) as m from dog) group by image_id""")
def ker08(spark, sf):
    d = checkpointed(A.difference_of_gaussians(V.pixels(spark, sf), "value", 1.0, "8", "8", "v"))
    return median_abs_dev(d, ["image_id"], "v").selectExpr("image_id", "round(1.4826D * mad, 6) as rms")


def _hess_views(s):
    k = [kernel(s, o) for o in (0, 1, 2)]
    n = f"{s:g}"
    oracle.define(f"hxx{n}", ("pixels",), conv_sql("pixels", "value", k[2], k[0], "v"))
    oracle.define(f"hyy{n}", ("pixels",), conv_sql("pixels", "value", k[0], k[2], "v"))
    oracle.define(f"hxy{n}", ("pixels",), conv_sql("pixels", "value", k[1], k[1], "v"))
    oracle.define(f"hess{n}", (f"hxx{n}", f"hyy{n}", f"hxy{n}"), f"""
      select image_id, y, x, {s * s} * greatest(tr + di - abs(tr - di), 0) as dark,
        {s * s} * greatest(-(tr - di) - abs(tr + di), 0) as bright, 0.5 * atan2(2 * c, a - b) as phi from (
        select *, 0.5 * (a + b) as tr, sqrt(power(0.5 * (a - b), 2) + c * c) as di from (
          select p.image_id, p.y, p.x, p.v as a, q.v as b, r.v as c from hxx{n} p
          join hyy{n} q on q.image_id = p.image_id and q.y = p.y and q.x = p.x
          join hxy{n} r on r.image_id = p.image_id and r.y = p.y and r.x = p.x))""")


_hess_views(1.0)
_hess_views(2.0)


@query("ker03_hessian", "hess1", """
  select image_id, y, x, round(dark, 6) as dark, round(bright, 6) as bright from hess1""")
def ker03(spark, sf):
    return A.hessian(V.pixels(spark, sf), "value", 1.0, "8", "8").selectExpr(
        "image_id", "y", "x", "round(dark, 6) as dark", "round(bright, 6) as bright")


def _scales(spark, sf):
    p = V.pixels(spark, sf)
    d = None
    for s in (1.0, 2.0):
        h = A.hessian(p, "value", s, "8", "8").withColumn("scale", F.lit(int(s)).cast("long"))
        d = h if d is None else d.unionByName(h)
    return checkpointed(d)


oracle.define("ridges", ("hess1", "hess2"), """
  with a as (select *, 1::bigint as scale from hess1 union all select *, 2 from hess2),
  t as (select image_id, scale, greatest(quantile_cont(bright, 0.95), 0.354 * 0.03) as t from a group by image_id, scale)
  select a.*, t.t, dark / t.t as r from a join t on t.image_id = a.image_id and t.scale = a.scale""")


def _ridges(spark, sf):
    d = _scales(spark, sf)
    q = quantiles(d, ["image_id", "scale"], "bright", {"q": 0.95}).selectExpr(
        "image_id", "scale", "greatest(q, 0.354D * 0.03D) as t")
    return d.join(q, ["image_id", "scale"]).withColumn("r", F.expr("dark / t"))


@query("ker04_ridge_mask", "ridges", """
  select image_id, count(*) filter (best > 1) as n_mask, count(*) filter (best > 1 and scale = 1) as n_fine,
    round(max(best), 5) as top from (
    select image_id, y, x, max(r) as best, arg_max(scale, {'r': r, 's': scale}) as scale from ridges
    group by image_id, y, x) group by image_id""")
def ker04(spark, sf):
    """Strength over the texture threshold of its scale, best scale per pixel, pixels above 1."""
    b = _ridges(spark, sf).groupBy("image_id", "y", "x").agg(
        F.max("r").alias("best"), F.expr("max_by(scale, struct(r, scale))").alias("scale"))
    return b.groupBy("image_id").agg(F.expr("count_if(best > 1)").alias("n_mask"),
                                     F.expr("count_if(best > 1 and scale = 1)").alias("n_fine"),
                                     F.expr("round(max(best), 5)").alias("top"))


@query("agg25_scale_shares", "ridges", """
  select scale, count(*) filter (best > 1) as n, round(count(*) filter (best > 1) / sum(count(*)) over (), 6) as share from (
    select image_id, y, x, max(r) as best, arg_max(scale, {'r': r, 's': scale}) as scale from ridges
    group by image_id, y, x) group by scale""")
def agg25(spark, sf):
    b = _ridges(spark, sf).groupBy("image_id", "y", "x").agg(
        F.max("r").alias("best"), F.expr("max_by(scale, struct(r, scale))").alias("scale"))
    g = b.groupBy("scale").agg(F.expr("count_if(best > 1)").alias("n"), F.count(F.lit(1)).alias("c"))
    # one row per scale is left
    return g.selectExpr("scale", "n", "round(n / sum(c) over (), 6) as share")


@query("ker07_pixel_noise", "pixels", f"""
  , l as (select p.image_id, sum(q.value) - 4 * any_value(p.value) as lap from pixels p
    cross join (values (0, 1), (0, -1), (1, 0), (-1, 0)) k(dy, dx) join pixels q on q.image_id = p.image_id
    and q.y = {refl('p.y + k.dy', 8)} and q.x = {refl('p.x + k.dx', 8)} group by p.image_id, p.y, p.x)
  select image_id, round(1.4826 * median(abs(lap - m)) / sqrt(20), 6) as noise from (
    select *, median(lap) over (partition by image_id) as m from l) group by image_id""")
def ker07(spark, sf):
    l = checkpointed(A.laplacian(V.pixels(spark, sf), "value", "8", "8"))
    return median_abs_dev(l, ["image_id"], "lap").selectExpr("image_id", "round(1.4826D * mad / sqrt(20.0D), 6) as noise")


@query("ker11_minus_local_mean", "pixels", """
  , s as (select *, value > -0.2 as valid, case when value > -0.2 then ln(1.5 + value) else 0 end as l,
      (value > -0.2)::int::double as v from pixels), num as (""" + conv_sql(
    "s", "l", kernel(1.5), kernel(1.5), "n") + "), den as (" + conv_sql("s", "v", kernel(1.5), kernel(1.5), "d") + """)
  select s.image_id, s.y, s.x, round(l - n / greatest(d, 1e-6), 6) as g from s
  join num on num.image_id = s.image_id and num.y = s.y and num.x = s.x
  join den on den.image_id = s.image_id and den.y = s.y and den.x = s.x where valid""")
def ker11(spark, sf):
    """Log value less its Gaussian mean over the valid pixels around."""
    s = V.pixels(spark, sf).selectExpr("image_id", "y", "x", "value > -0.2D as valid",
                                       "case when value > -0.2D then ln(1.5D + value) else 0.0D end as l",
                                       "cast(cast(value > -0.2D as int) as double) as v")
    k = kernel(1.5)
    d = A.convolve(s, {"_l": ("l", k), "_v": ("v", k)}, "x", "8")
    d = A.convolve(d, {"n": ("_l", k), "d": ("_v", k)}, "y", "8").where("valid")
    return d.selectExpr("image_id", "y", "x", "round(l - n / greatest(d, 1e-6D), 6) as g")


@query("ker06_fill_invalid", "pixels", """
  , s as (select *, value < 0.2 as valid, case when value < 0.2 then value else 0 end as l,
      (value < 0.2)::int::double as v from pixels), num as (""" + conv_sql(
    "s", "l", kernel(1.0), kernel(1.0), "n") + "), den as (" + conv_sql("s", "v", kernel(1.0), kernel(1.0), "d") + """)
  select s.image_id, s.y, s.x, round(n / d, 6) as value from s
  join num on num.image_id = s.image_id and num.y = s.y and num.x = s.x
  join den on den.image_id = s.image_id and den.y = s.y and den.x = s.x where not valid and d > 1e-3""")
def ker06(spark, sf):
    s = V.pixels(spark, sf).selectExpr("image_id", "y", "x", "case when value < 0.2D then value end as value")
    return fill_invalid(s, 1.0, "8", "8", 8).where("filled").selectExpr("image_id", "y", "x", "round(value, 6) as value")


def fill_invalid(px, sigma, w, h, size):
    """NULL pixels from the Gaussian mean of the valid ones; the Gaussian doubles for pixels it does not reach. They stay
    NULL in an image without a valid pixel."""
    base = checkpointed(px.selectExpr("image_id", "y", "x", "value", "coalesce(value, 0.0D) as l",
                                      "cast(cast(value is not null as int) as double) as v"))
    todo, out, s = base.where("value is null").select("image_id", "y", "x"), None, sigma
    while s < 4 * size:
        k = kernel(s)
        d = A.convolve(base, {"_l": ("l", k), "_v": ("v", k)}, "x", w)
        d = A.convolve(d, {"n": ("_l", k), "d": ("_v", k)}, "y", h)
        got = checkpointed(d.where("d > 1e-3D").join(todo, ["image_id", "y", "x"], "left_semi")
                           .selectExpr("image_id", "y", "x", "n / d as value", "true as filled"))
        out = got if out is None else out.unionByName(got)
        todo = checkpointed(todo.join(got, ["image_id", "y", "x"], "left_anti"))
        if todo.isEmpty():
            break
        s *= 2
    known = base.where("value is not null").selectExpr("image_id", "y", "x", "value", "false as filled")
    left = todo.selectExpr("image_id", "y", "x", "cast(null as double) as value", "true as filled")
    return known.unionByName(left if out is None else out.unionByName(left))


@query("ker09_whitened", "hess1", """
  , b as (select *, bright * bright as bb from hess1), n as (""" + conv_sql("b", "bb", kernel(1.5), kernel(1.5), "v") + """)
  select h.image_id, h.y, h.x, round(dark / greatest(sqrt(greatest(v, 0)), 0.354 * 0.02 / 2.5), 5) as strength
  from hess1 h join n on n.image_id = h.image_id and n.y = h.y and n.x = h.x""")
def ker09(spark, sf):
    """Dark-line strength over the local RMS of the opposite polarity, with a floor."""
    d = checkpointed(A.hessian(V.pixels(spark, sf), "value", 1.0, "8", "8").withColumn("bb", F.expr("bright * bright")))
    g = A.gaussian(d, "bb", 1.5, "8", "8", "v")
    return g.selectExpr("image_id", "y", "x", "round(dark / greatest(sqrt(greatest(v, 0.0D)), 0.354D * 0.02D / 2.5D), 5) "
                        "as strength")


@query("ker05_block_background", "raster", """
  , b as (select image_id, y // 10 as by, x // 10 as bx, quantile_cont(ln(price), 0.8) as g from raster
    group by image_id, y // 10, x // 10 having count(*) > 12)
  select image_id, round(avg(f), 6) as mean_f, round(stddev_pop(f), 6) as sd_f, count(*) as n from (
    select r.image_id, ln(r.price) - b.g as f from raster r join b on b.image_id = r.image_id and b.by = r.y // 10
      and b.bx = r.x // 10) group by image_id""")
def ker05(spark, sf):
    """80th percentile of the log values per block (blocks with too few pixels left out), taken off."""
    r = V.raster(spark, sf).selectExpr("image_id", "y div 10 as by", "x div 10 as bx", "ln(price) as l")
    # a block is at most 100 pixels
    b = r.groupBy("image_id", "by", "bx").agg(F.expr("percentile(l, 0.8D)").alias("g"), F.count(F.lit(1)).alias("n"))
    f = r.join(b.where("n > 12").drop("n"), ["image_id", "by", "bx"]).withColumn("f", F.expr("l - g"))
    return f.groupBy("image_id").agg(F.expr("round(avg(f), 6)").alias("mean_f"),
                                     F.expr("round(stddev_pop(f), 6)").alias("sd_f"), F.count(F.lit(1)).alias("n"))


@query("ker10_eroded_valid", "raster", """
  select image_id, y, x from raster p where value <= 45 and y >= 2 and x >= 2 and x < 48
    and y < (select max(y) + 1 - 2 from raster q where q.image_id = p.image_id)
    and not exists (select 1 from raster q where q.image_id = p.image_id and q.value > 45
      and abs(q.y - p.y) <= 2 and abs(q.x - p.x) <= 2 and power(q.y - p.y, 2) + power(q.x - p.x, 2) <= 4)""")
def ker10(spark, sf):
    """Valid pixels at least 2 px from invalid ones and from the border."""
    r = V.raster(spark, sf).selectExpr("image_id", "cast(y as double) as y", "cast(x as double) as x", "value")
    h = r.groupBy("image_id").agg((F.max("y") + 1).alias("h"))
    d = near_positions(r.where("value <= 45"), r.where("value > 45"), 2.0).where("not hit").join(h, "image_id")
    return d.where("y >= 2 and x >= 2 and x < 48 and y < h - 2").selectExpr(
        "image_id", "cast(y as bigint) as y", "cast(x as bigint) as x")


# ------------------------------------------------------------------------------------------------ skeletons
oracle.define("nb8", ("skeleton",), """
  select a.image_id, a.pid as src, b.pid as dst, b.y - a.y as dy, b.x - a.x as dx, a.y, a.x from skeleton a
  join skeleton b on a.image_id = b.image_id and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 and a.pid <> b.pid""")
oracle.define("links", ("nb8",), """
  select src, dst from nb8 n where dy = 0 or dx = 0 or not exists (select 1 from skeleton m where m.image_id = n.image_id
    and ((m.y = n.y + n.dy and m.x = n.x) or (m.y = n.y and m.x = n.x + n.dx)))""")
oracle.define("crowd", ("nb8", "skeleton"), """
  select s.*, coalesce(c, 0) as nb from skeleton s left join (select src, count(*) as c from nb8 group by src) n
    on n.src = s.pid""")
oracle.define("zone", ("crowd",), """
  select distinct image_id, y + dy as y, x + dx as x from crowd cross join (values (-1), (0), (1)) a(dy)
    cross join (values (-1), (0), (1)) b(dx) where nb >= 3""")
oracle.define("brp", ("crowd", "zone"), """
  select c.* from crowd c where not exists (select 1 from zone z where z.image_id = c.image_id and z.y = c.y
    and z.x = c.x)""")
RECURSE = """--recursive
  , r as (select pid as node, pid as root from {src} union select b.pid, r.root from r join {src} a on a.pid = r.node
    join {src} b on b.image_id = a.image_id and {near} and a.pid <> b.pid),
  lab as (select node, min(root) as comp from r group by node)"""
NEAR8 = "abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1"
NEAR4 = "abs(a.y - b.y) + abs(a.x - b.x) = 1"


@query("skl01_pixel_graph", "links", "select src, dst from links")
def skl01(spark, sf):
    return A.skeleton_links(checkpointed(V.skeleton(spark, sf))).select("src", "dst")


@query("skl02_branch_lengths", "brp zone", RECURSE.format(src="brp", near=NEAR8) + """
  select b.image_id, comp, count(*) as n, count(*) filter (nb = 1) as n_ends,
    bool_or(exists (select 1 from zone z where z.image_id = b.image_id and abs(z.y - b.y) <= 1 and abs(z.x - b.x) <= 1))
    as touches from brp b join lab on lab.node = b.pid group by b.image_id, comp""")
def skl02(spark, sf):
    """Branches of the skeleton once its junction pixels are cut out."""
    b = A.branches(V.skeleton(spark, sf))
    return b.groupBy("image_id", "comp").agg(F.count(F.lit(1)).alias("n"), F.expr("count_if(nb = 1)").alias("n_ends"),
                                             F.expr("bool_or(touches)").alias("touches"))


@query("skl02_densities", "crowd", RECURSE.format(src="jp", near=NEAR8).replace(
    ", r as", ", jp as (select * from crowd where nb >= 3), r as", 1) + """
  select c.image_id, count(*) as n_px, count(*) filter (nb = 1) as n_end, count(distinct comp) as n_junction
  from crowd c left join lab on lab.node = c.pid group by c.image_id""")
def skl02_densities(spark, sf):
    c = checkpointed(A.crowding(V.skeleton(spark, sf)))
    j = A.label(c.where("nb >= 3")).groupBy("image_id").agg(F.expr("count_if(pid = comp)").alias("n_junction"))
    return c.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_px"), F.expr("count_if(nb = 1)").alias("n_end")).join(
        j, "image_id", "left").na.fill(0)


@query("skl03_trace", "links skeleton", """--recursive
  , deg as (select s.*, coalesce(d, 0) as deg from skeleton s left join (select src, count(*) as d from links group by src) l
    on l.src = s.pid),
  line as (select * from deg where deg <= 2),
  le as (select src, dst from links join line a on a.pid = src join line b on b.pid = dst),
  r as (select pid as node, pid as root from line union select e.dst, r.root from r join le e on e.src = r.node),
  lab as (select node, min(root) as comp from r group by node)
  select comp, count(*) as n, count(*) filter (deg = 1) as n_free,
    (select count(distinct l.dst) from links l join lab b on b.node = l.src join deg d on d.pid = l.dst
      where b.comp = o.comp and d.deg >= 3) as n_node_px
  from line join lab o on o.node = line.pid group by comp""")
def skl03(spark, sf):
    """Branches: chains of pixels with at most two links, their free ends and the junction pixels they lead to."""
    s = checkpointed(V.skeleton(spark, sf))
    l = checkpointed(A.skeleton_links(s).select("src", "dst"))
    deg = checkpointed(s.join(l.groupBy(F.col("src").alias("pid")).agg(F.count(F.lit(1)).alias("deg")), "pid", "left")
                       .na.fill(0, ["deg"]).select("pid", "deg"))
    line = deg.where("deg <= 2")
    e = (l.join(line.selectExpr("pid as src"), "src", "left_semi").join(line.selectExpr("pid as dst"), "dst", "left_semi")
         .where("src < dst"))
    lab = checkpointed(N.connected_components(e, line.selectExpr("pid as node")))
    n = lab.join(line.withColumnRenamed("pid", "node"), "node").groupBy("comp").agg(
        F.count(F.lit(1)).alias("n"), F.expr("count_if(deg = 1)").alias("n_free"))
    at = (l.join(lab.selectExpr("node as src", "comp"), "src").join(deg.where("deg >= 3").selectExpr("pid as dst"), "dst",
                                                                   "left_semi").select("comp", "dst").distinct()
          .groupBy("comp").agg(F.count(F.lit(1)).alias("n_node_px")))
    return n.join(at, "comp", "left").na.fill(0, ["n_node_px"])


@query("skl03_merged_nodes")
def skl03_merged(spark, sf):
    """Junctions joined by branches of up to half a lambda as one node, with the branch ends that remain there."""
    br, pts = K.trace(checkpointed(V.skeleton(spark, sf)))
    merged = K.merge_nodes(br, 6.0)
    _, at = K.attach(br, K.arms(br, pts, 12.0), merged)
    return (merged.groupBy(F.col("merged").alias("node")).agg(F.count(F.lit(1)).alias("n_junctions"))
            .join(at.groupBy("node").agg(F.count(F.lit(1)).alias("n_arms")), "node", "left").na.fill(0, ["n_arms"]))


@query("skl09_continuation_paths")
def skl09(spark, sf):
    """Paths that go straight on through merged nodes and crossings."""
    p = K.continuation_paths(checkpointed(V.skeleton(spark, sf)), 12.0)["paths"]
    return p.selectExpr("image_id", "path", "n_branches", "round(length, 5) as length", "closed")


@query("skl09_crossings")
def skl09_crossings(spark, sf):
    """Where two continuation paths cross, and at which angle."""
    c = K.continuation_paths(checkpointed(V.skeleton(spark, sf)), 12.0)["crossings"]
    return c.selectExpr("image_id", "node", "round(y, 5) as y", "round(x, 5) as x", "round(angle, 5) as angle")


@query("skl04_spurs", "brp zone", RECURSE.format(src="brp", near=NEAR8) + """,
  s as (select comp from brp b join lab on lab.node = b.pid group by comp having count(*) < 8 and bool_or(nb = 1)
    and bool_or(exists (select 1 from zone z where z.image_id = b.image_id and abs(z.y - b.y) <= 1
      and abs(z.x - b.x) <= 1)))
  select image_id, pid, y, x from brp join lab on lab.node = brp.pid where comp in (select comp from s)""")
def skl04(spark, sf):
    return A.spur_pixels(V.skeleton(spark, sf))


@query("skl05_enclosed_loops", "raster", RECURSE.format(src="bg", near=NEAR4).replace(
    ", r as", ", bg as (select * from raster where value > 25), r as", 1) + """
  select b.image_id, comp, count(*) as area from bg b join lab on lab.node = b.pid
  join (select image_id, max(y) as h from raster group by image_id) t on t.image_id = b.image_id
  group by b.image_id, comp having not bool_or(y = 0 or x = 0 or x = 49 or y = h) and count(*) >= 2""")
def skl05(spark, sf):
    r = V.raster(spark, sf)
    r = r.join(r.groupBy("image_id").agg((F.max("y") + 1).alias("h")), "image_id")
    return A.enclosed(r, "value <= 25", "50", "h", 2)


oracle.define("mask_width", ("raster",), """
  select a.image_id, a.pid, a.y, a.x, a.value, min(power(a.y - b.y, 2) + power(a.x - b.x, 2)) as d2
  from raster a join raster b on b.image_id = a.image_id and b.value > 45 where a.value <= 45 group by all""")


@query("skl10_mask_width", "mask_width", RECURSE.format(src="wk", near=NEAR8).replace(
    ", r as", ", wk as (select * from mask_width where d2 >= 4), r as", 1) + """,
  k as (select comp from wk join lab on lab.node = wk.pid group by comp having bool_or(d2 >= 9)),
  wide as (select image_id, count(*) as n_wide, count(distinct comp) as wide_parts from wk join lab on lab.node = wk.pid
    where comp in (select comp from k) group by image_id)
  select m.image_id, count(*) as n, round(2 * median(sqrt(d2)), 6) as med, round(2 * quantile_cont(sqrt(d2), 0.9), 6) as p90,
    round(2 * max(sqrt(d2)), 6) as widest, coalesce(any_value(n_wide), 0) as n_wide, coalesce(any_value(wide_parts), 0) as wide_parts
  from mask_width m left join wide w on w.image_id = m.image_id group by m.image_id""")
def skl10_width(spark, sf):
    """Width of the mask at every pixel, twice the exact distance to its outside, and the wide components: pixels at least 4 wide that
    hang together with one at least 6 wide."""
    r = V.raster(spark, sf)
    d = checkpointed(D.distance_transform(r, "value <= 45").join(r.select("image_id", "y", "x", "pid"), ["image_id", "y", "x"])
                     .withColumn("w", F.expr("2 * sqrt(d2)")))
    wide = A.hysteresis(d, "d2 >= 4", "d2 >= 9").groupBy("image_id").agg(F.count(F.lit(1)).alias("n_wide"), F.count_distinct("comp").alias("wide_parts"))
    q = quantiles(d, ["image_id"], "w", {"med": 0.5, "p90": 0.9}, count="n").join(d.groupBy("image_id").agg(F.max("w").alias("widest")), "image_id")
    return q.join(wide, "image_id", "left").na.fill(0, ["n_wide", "wide_parts"]).selectExpr(
        "image_id", "n", "round(med, 6) as med", "round(p90, 6) as p90", "round(widest, 6) as widest", "n_wide", "wide_parts")


@query("itr13_hysteresis", "raster", RECURSE.format(src="wk", near=NEAR8).replace(
    ", r as", ", wk as (select * from raster where value <= 14), r as", 1) + """,
  k as (select comp from wk join lab on lab.node = wk.pid group by comp having bool_or(value <= 3) and count(*) > 4)
  select image_id, pid, comp from wk join lab on lab.node = wk.pid where comp in (select comp from k)""")
def itr13(spark, sf):
    return A.hysteresis(V.raster(spark, sf), "value <= 14", "value <= 3", 4).select("image_id", "pid", "comp")


@query("agg36_largest_web", "raster", RECURSE.format(src="wk", near=NEAR8).replace(
    ", r as", ", wk as (select * from raster where value <= 14), r as", 1) + """,
  c as (select image_id, comp, count(*) filter (value <= 7) as n, max(y) - min(y) + 1 as sy, max(x) - min(x) + 1 as sx
    from wk join lab on lab.node = wk.pid group by image_id, comp)
  select image_id, round(max(n) / sum(n), 6) as largest, round(coalesce(sum(n) filter (sy >= 20 or sx >= 25), 0) / sum(n), 6)
    as spanning from c group by image_id""")
def agg36(spark, sf):
    """Share of the darker pixels in the largest component and in those spanning half the frame."""
    b = A.label(V.raster(spark, sf).where("value <= 14"))
    c = b.groupBy("image_id", "comp").agg(F.expr("count_if(value <= 7)").alias("n"),
                                          F.expr("max(y) - min(y) + 1").alias("sy"),
                                          F.expr("max(x) - min(x) + 1").alias("sx"))
    return c.groupBy("image_id").agg(F.expr("round(max(n) / sum(n), 6)").alias("largest"), F.expr(
        "round(coalesce(sum(case when sy >= 20 or sx >= 25 then n end), 0) / sum(n), 6)").alias("spanning"))


@query("agg50_holes", "raster", RECURSE.format(src="wk", near=NEAR4).replace(
    ", r as", ", wk as (select * from raster where value > 30), r as", 1) + """,
  c as (select w.image_id, comp, count(*) as area, bool_or(y = 0 or x = 0 or x = 49 or y = h) as border from wk w
    join lab on lab.node = w.pid join (select image_id, max(y) as h from raster group by image_id) t
    on t.image_id = w.image_id group by w.image_id, comp)
  select image_id, cast(rank as bigint) as rank, comp, area from (select *, row_number() over (partition by image_id
    order by area desc, comp) as rank from c where not border) where rank <= 6""")
def agg50(spark, sf):
    """The six largest no-data holes inside an image."""
    r = V.raster(spark, sf)
    r = r.join(r.groupBy("image_id").agg((F.max("y") + 1).alias("h")), "image_id")
    c = A.enclosed(r, "value <= 30", "50", "h", 1)
    return top_by(c, ["image_id"], [F.col("area").desc(), F.col("comp")], 6).select("image_id", "rank", "comp", "area")


@query("skl11_local_tangents", "skeleton", """
  select image_id, pid, n, round(cxx, 6) as cxx, round(cxy, 6) as cxy, round(cyy, 6) as cyy, round(
    degrees(0.5 * atan2(2 * cxy, cxx - cyy)), 4) as theta from (
    select a.image_id, a.pid, count(*) as n, sum(b.x * b.x) - sum(b.x) * sum(b.x) / count(*) as cxx,
      sum(b.y * b.y) - sum(b.y) * sum(b.y) / count(*) as cyy, sum(b.x * b.y) - sum(b.x) * sum(b.y) / count(*) as cxy
    from skeleton a join skeleton b on a.image_id = b.image_id and power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 16
    group by a.image_id, a.pid) where abs(cxy) > 1e-6 or cxx - cyy > 1e-6""")
def skl11(spark, sf):
    """Principal direction of the skeleton points within 4 px, from sums."""
    s = V.skeleton(spark, sf).select("image_id", "pid", "y", "x")
    p = J.grid_join(J.tag(s, "a"), J.tag(s, "b"), 4.0, f"{J.D2} <= 16")
    c = p.groupBy("image_id", F.col("a_pid").alias("pid")).agg(
        F.count(F.lit(1)).alias("n"), F.expr("sum(b_x * b_x) - sum(b_x) * sum(b_x) / count(1)").alias("cxx"),
        F.expr("sum(b_y * b_y) - sum(b_y) * sum(b_y) / count(1)").alias("cyy"),
        F.expr("sum(b_x * b_y) - sum(b_x) * sum(b_y) / count(1)").alias("cxy"))
    return c.where("abs(cxy) > 1e-6 or cxx - cyy > 1e-6").selectExpr(
        "image_id", "pid", "n", "round(cxx, 6) as cxx", "round(cxy, 6) as cxy", "round(cyy, 6) as cyy",
        "round(degrees(0.5D * atan2(2 * cxy, cxx - cyy)), 4) as theta")


@query("skl12_junction_zone", "crowd raster", """
  select r.image_id, r.pid from raster r where exists (select 1 from crowd j where j.image_id = r.image_id and j.nb >= 5
    and power(j.x - r.x, 2) + power(j.y - r.y, 2) <= 6.25)""")
def skl12(spark, sf):
    j = A.crowding(checkpointed(V.skeleton(spark, sf))).where("nb >= 5").selectExpr(
        "image_id", "cast(x as double) as x", "cast(y as double) as y")
    r = V.raster(spark, sf).selectExpr("image_id", "pid", "cast(x as double) as x", "cast(y as double) as y")
    return near_positions(r, j, 2.5).where("hit").select("image_id", "pid")


@query("agg24_box_dimension", "skeleton", """
  select image_id, round(-regr_slope(ln(n), ln(b)), 6) as dimension from (
    select image_id, b, count(distinct (y // b) * 1000 + x // b) as n from skeleton cross join (values (2), (4), (8), (16))
    k(b) group by image_id, b) group by image_id having count(*) >= 3""")
def agg24(spark, sf):
    s = V.skeleton(spark, sf).selectExpr("image_id", "y", "x", "explode(array(2L, 4L, 8L, 16L)) as b")
    n = s.selectExpr("image_id", "b", "y div b as by", "x div b as bx").distinct().groupBy("image_id", "b").agg(
        F.count(F.lit(1)).alias("n"))
    return n.groupBy("image_id").agg(F.expr("round(-regr_slope(ln(n), ln(b)), 6)").alias("dimension"),
                                     F.count(F.lit(1)).alias("k")).where("k >= 3").drop("k")


def _theta(e):
    return f"radians(({e} * 37) % 180)"


@query("agg32_pair_histogram", "skeleton", f"""
  , p as (select a.image_id, abs(-(b.x - a.x) * sin(a.th) + (b.y - a.y) * cos(a.th)) as v,
      abs((b.x - a.x) * cos(a.th) + (b.y - a.y) * sin(a.th)) as u,
      least(abs(a.t - b.t) % 180, 180 - abs(a.t - b.t) % 180) as dt
    from (select *, {_theta('pid')} as th, (pid * 37) % 180 as t from skeleton) a
    join (select *, (pid * 37) % 180 as t from skeleton) b on a.image_id = b.image_id and a.pid <> b.pid
      and power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 1600)
  select image_id, cast(floor((v - 1e-9) / 2) as bigint) as bin, count(*) filter (dt < 15) as n_par,
    count(*) filter (dt > 60) as n_perp from p where u <= 2 and v >= 2.000001 group by image_id, 2""")
def agg32(spark, sf):
    """Histogram of perpendicular distances to parallel and to crossing neighbours."""
    return _pairs(spark, sf).groupBy("image_id", F.expr("cast(floor((v - 1e-9D) / 2) as bigint)").alias("bin")).agg(
        F.expr("count_if(dt < 15)").alias("n_par"), F.expr("count_if(dt > 60)").alias("n_perp"))


def _pairs(spark, sf):
    s = V.skeleton(spark, sf).selectExpr("image_id", "pid", "y", "x", "(pid * 37) % 180 as t")
    p = J.grid_join(J.tag(s, "a"), J.tag(s, "b"), 40.0, f"a_pid <> b_pid and {J.D2} <= 1600")
    th = "radians(a_t)"
    return p.selectExpr("image_id", f"abs(-(b_x - a_x) * sin({th}) + (b_y - a_y) * cos({th})) as v",
                        f"abs((b_x - a_x) * cos({th}) + (b_y - a_y) * sin({th})) as u",
                        "least(abs(a_t - b_t) % 180, 180 - abs(a_t - b_t) % 180) as dt").where(
        "u <= 2 and v >= 2.000001D")


@query("jn21_parallel_neighbours", "skeleton", f"""
  select a.image_id, count(*) as n, round(sum(abs(-(b.x - a.x) * sin(a.th) + (b.y - a.y) * cos(a.th))), 3) as sum_v
  from (select *, {_theta('pid')} as th, (pid * 37) % 180 as t from skeleton) a
  join (select *, (pid * 37) % 180 as t from skeleton) b on a.image_id = b.image_id and a.pid <> b.pid
    and power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 1600
  where abs((b.x - a.x) * cos(a.th) + (b.y - a.y) * sin(a.th)) <= 2
    and abs(-(b.x - a.x) * sin(a.th) + (b.y - a.y) * cos(a.th)) >= 2.000001
    and least(abs(a.t - b.t) % 180, 180 - abs(a.t - b.t) % 180) < 15 group by a.image_id""")
def jn21(spark, sf):
    return _pairs(spark, sf).where("dt < 15").groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"), F.expr("round(sum(v), 3)").alias("sum_v"))


# ------------------------------------------------------------------------------------------------ rasters
def _spots(spark, sf):
    return V.obs_junctions(spark, sf).selectExpr("image_id", "jid", "type", "x as px", "y as py", "radius / 4 as rr",
                                                 "cast(jid % 40 as double) as depth")


@query("ras01_heatmaps", "obs_junctions", """
  select image_id, type, y, x, round(max(exp(-(power(px - x, 2) + power(py - y, 2)) / 2)), 6) as heat from (
    select image_id, type, j.x as px, j.y as py, cast(j.y + dy as bigint) as y, cast(j.x + dx as bigint) as x
    from obs_junctions j cross join (select unnest(range(-3, 4)) as dy) a cross join (select unnest(range(-3, 4)) as dx) b)
  where y between 0 and 99 and x between 0 and 159 and power(px - x, 2) + power(py - y, 2) <= 9
  group by image_id, type, y, x""")
def ras01(spark, sf):
    """Gaussian spots of junctions per type, the larger value where they overlap."""
    d = A.disc(spread(_spots(spark, sf), 20_000), "3", 160, 100)
    return d.groupBy("image_id", "type", "y", "x").agg(F.expr(
        "round(max(exp(-(power(px - x, 2) + power(py - y, 2)) / 2)), 6)").alias("heat"))


oracle.define("lumen", ("samples",), """
  select distinct image_id, vid, z, cast(y + dy as bigint) as py, cast(x + dx as bigint) as px, observable,
    power(dx, 2) + power(dy, 2) as d2 from obs cross join (select unnest(range(-3, 4)) as dy) a
    cross join (select unnest(range(-3, 4)) as dx) b
  where power(dx, 2) + power(dy, 2) <= r * r and y + dy between 0 and 99 and x + dx between 0 and 159""")
oracle.VIEWS["lumen"] = (("obs",), oracle.VIEWS["lumen"][1])


def _lumen(s, *more):
    d = s.selectExpr("image_id", "vid", "z", "x as px", "y as py", "r", "observable", "peak", *more)
    return A.disc(d, "r", 160, 100)


@query("ras02_lumen_masks", "flags", """
  , d as (select image_id, cast(y + dy as bigint) as py, cast(x + dx as bigint) as px, bool_or(observable) as o, bool_or(dont_care) as c
    from flags, (select unnest(range(-3, 4)) as dy), (select unnest(range(-3, 4)) as dx)
    where dx * dx + dy * dy <= r * r and y + dy between 0 and 99 and x + dx between 0 and 159 group by all)
  select image_id, count(*) filter (o) as n_lumen, count(*) filter (c and not o) as n_dont_care from d group by image_id""")
def ras02(spark, sf):
    """Pixels under observable samples, and those outside them under samples that may be seen: in frame, permissively
    seen and not observable."""
    from filigrane.operators.runs import dont_care
    d = _lumen(dont_care(V.samples(spark, sf)), "dont_care")
    p = d.groupBy("image_id", "y", "x").agg(F.expr("bool_or(observable)").alias("o"), F.expr("bool_or(dont_care)").alias("c"))
    return p.groupBy("image_id").agg(F.expr("count_if(o)").alias("n_lumen"), F.expr("count_if(c and not o)").alias("n_dont_care"))


@query("ras03_centreline_ids", "obs", """
  select image_id, cast(y as bigint) as y, cast(x as bigint) as x, max(vid) as vid from obs where observable
  group by image_id, y, x""")
def ras03(spark, sf):
    """Pixels of the observable lines with the edge written last."""
    from filigrane.operators.runs import observable
    return observable(V.samples(spark, sf)).where("observable").groupBy(
        "image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).agg(F.max("vid").alias("vid"))


@query("top03_shallowest_id", "samples", """
  select image_id, cast(y as bigint) as y, cast(x as bigint) as x, arg_min(vid, {'z': z, 'v': vid}) as vid
  from samples where in_frame group by image_id, y, x""")
def top03(spark, sf):
    return V.samples(spark, sf).where("in_frame").groupBy(
        "image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).agg(
        F.expr("min_by(vid, struct(z, vid))").alias("vid"))


@query("top01_dominant_edges", "samples", """
  , v as (select image_id, vid, cast(y + dy as bigint) as y, cast(x + dx as bigint) as x,
      max(peak * exp(-(dx * dx + dy * dy) / (2 * r * r))) as v
    from samples cross join (select unnest(range(-3, 4)) as dy) a cross join (select unnest(range(-3, 4)) as dx) b
    where dx * dx + dy * dy <= r * r and y + dy between 0 and 99 and x + dx between 0 and 159 group by image_id, vid, 3, 4),
  k as (select *, row_number() over (partition by image_id, y, x order by v desc, vid) as k from v where v >= 1e-4)
  select image_id, y, x, max(vid) filter (k = 1) as first, max(vid) filter (k = 2) as second,
    round(max(v) filter (k = 1), 6) as value from k where k <= 2 group by image_id, y, x""")
def top01(spark, sf):
    """Strongest and second strongest edge per pixel. One row per pixel and edge is left before they are ranked, and
    the two maxima come from aggregates, not from a sort of the pixel."""
    s = V.samples(spark, sf).selectExpr("image_id", "vid", "x as px", "y as py", "r", "peak")
    d = A.disc(s, "r", 160, 100).withColumn("v", F.expr(
        "peak * exp(-(power(px - x, 2) + power(py - y, 2)) / (2 * r * r))"))
    v = checkpointed(d.groupBy("image_id", "y", "x", "vid").agg(F.max("v").alias("v")).where("v >= 1e-4"))
    one = v.groupBy("image_id", "y", "x").agg(F.expr("max(struct(v, -vid as nv))").alias("m"))
    rest = v.join(one, ["image_id", "y", "x"]).where("vid <> -m.nv").groupBy("image_id", "y", "x").agg(
        F.expr("-max(struct(v, -vid as nv)).nv").alias("second"))
    return one.join(rest, ["image_id", "y", "x"], "left").selectExpr(
        "image_id", "y", "x", "-m.nv as first", "second", "round(m.v, 6) as value")


@query("top02_shallowest_edges", "lumen", """
  , v as (select distinct image_id, vid, z, py as y, px as x from lumen),
  k as (select *, row_number() over (partition by image_id, y, x order by z, vid) as k from v)
  select image_id, y, x, max(vid) filter (k = 1) as top, max(vid) filter (k = 2) as below from k where k <= 2
  group by image_id, y, x""")
def top02(spark, sf):
    """The edge on top of a pixel and the next one below."""
    s = V.samples(spark, sf).selectExpr("image_id", "vid", "z", "x as px", "y as py", "r")
    v = checkpointed(A.disc(s, "r", 160, 100).select("image_id", "y", "x", "vid", "z").distinct())
    one = v.groupBy("image_id", "y", "x").agg(F.expr("min(struct(z, vid))").alias("m"))
    rest = v.join(one, ["image_id", "y", "x"]).where("vid <> m.vid").groupBy("image_id", "y", "x").agg(
        F.expr("min(struct(z, vid)).vid").alias("below"))
    return one.join(rest, ["image_id", "y", "x"], "left").selectExpr("image_id", "y", "x", "m.vid as top", "below")


@query("ras04_arm_directions", "", """
  , a as (select l_orderkey as jid, l_linenumber as arm, (l_orderkey * 37) % 160 as cx, (l_orderkey * 53) % 100 as cy,
      (l_partkey % 13) - 6 as dx, (l_suppkey % 11) - 5 as dy from lineitem)
  select jid, y, x, max(arm) as arm from (select jid, arm, cast(floor(cx + k / 8.0 * dx + 0.5) as bigint) as x,
      cast(floor(cy + k / 8.0 * dy + 0.5) as bigint) as y from a cross join (select unnest(range(9)) as k))
  group by jid, y, x""")
def ras04(spark, sf):
    """Segments from a junction to its arms on the pixel grid; the arm that comes last owns a pixel."""
    a = V.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey as jid", "l_linenumber as arm", "(l_orderkey * 37) % 160 as cx", "(l_orderkey * 53) % 100 as cy",
        "(l_partkey % 13) - 6 as dx", "(l_suppkey % 11) - 5 as dy", "explode(sequence(0, 8)) as k")
    return a.selectExpr("jid", "arm", "cast(floor(cx + k / 8.0D * dx + 0.5D) as bigint) as x",
                        "cast(floor(cy + k / 8.0D * dy + 0.5D) as bigint) as y").groupBy("jid", "y", "x").agg(
        F.max("arm").alias("arm"))


SQ = math.sqrt(2 * math.pi)


@query("pro01_profiles", "", f"""
  , p as (select vec_id as pid, cast(t as bigint) as t, cast(embedding[t + 1] as double) as p from (select *,
      unnest(range(len(embedding))) as t from embeddings)),
  c as (select pid, arg_min(t, {{'p': p, 't': t}}) as i0, min(p) as pmin from p where t between 24 and 40 group by pid),
  o as (select p.pid, p.t, p.p, pmin, i0, sign(p.t - i0) as side, abs(p.t - i0) as k from p join c on c.pid = p.pid
    where p.t <> i0),
  m as (select *, greatest(coalesce(max(p) over (partition by pid, side order by k rows between unbounded preceding and
      1 preceding), pmin), pmin) as mb from o),
  v as (select *, p <= mb and p < mb - greatest(0.2 * (mb - pmin), 0.002) as bad from m),
  s as (select *, min(case when bad then k end) over (partition by pid, side) as stop from v),
  sh as (select pid, side, any_value(pmin) as pmin, max(p) as top, arg_max(k, {{'p': p, 'k': -k}}) as at from s
    where stop is null or k < stop group by pid, side)
  select l.pid, round(least(l.top, r.top) - l.pmin, 6) as contrast, cast(l.at as bigint) as il, cast(r.at as bigint) as ir,
    round(abs(l.top - r.top) / (greatest(l.top, r.top) - l.pmin), 6) as asym
  from sh l join sh r on r.pid = l.pid and r.side = 1 where l.side = -1 and l.top > l.pmin and r.top > r.pmin
    and least(l.top, r.top) - l.pmin > 0.01""")
def pro01(spark, sf):
    """Cross sections (64 samples each): the minimum near the middle, the two shoulders up to where the profile drops
    back, contrast and asymmetry."""
    p = V.table(spark, sf, "embeddings").selectExpr("vec_id as pid", "posexplode(embedding) as (t, e)").selectExpr(
        "pid", "cast(t as bigint) as t", "cast(e as double) as p")
    c = p.where("t between 24 and 40").groupBy("pid").agg(F.expr("min(struct(p, t))").alias("m")).selectExpr(
        "pid", "m.t as i0", "m.p as pmin")
    from pyspark.sql import Window
    o = p.join(c, "pid").where("t <> i0").selectExpr("pid", "p", "pmin", "sign(t - i0) as side", "abs(t - i0) as k")
    w = Window.partitionBy("pid", "side").orderBy("k")
    o = o.withColumn("mb", F.greatest(F.coalesce(F.max("p").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                                 F.col("pmin")), F.col("pmin")))
    o = o.withColumn("bad", F.expr("p <= mb and p < mb - greatest(0.2D * (mb - pmin), 0.002D)"))
    o = o.withColumn("stop", F.min(F.expr("case when bad then k end")).over(Window.partitionBy("pid", "side")))
    sh = o.where("stop is null or k < stop").groupBy("pid", "side").agg(
        F.first("pmin").alias("pmin"), F.expr("max(struct(p, -k as nk))").alias("m"))
    l = sh.where("side = -1").selectExpr("pid", "pmin", "m.p as lt", "-m.nk as il")
    r = sh.where("side = 1").selectExpr("pid", "m.p as rt", "-m.nk as ir")
    return l.join(r, "pid").where("lt > pmin and rt > pmin and least(lt, rt) - pmin > 0.01D").selectExpr(
        "pid", "round(least(lt, rt) - pmin, 6) as contrast", "il", "ir",
        "round(abs(lt - rt) / (greatest(lt, rt) - pmin), 6) as asym")
