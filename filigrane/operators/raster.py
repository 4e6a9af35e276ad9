"""Kernels, skeletons and rasters on pixel tables (image_id, y, x, value)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane.operators.network import connected_components
from filigrane.operators.paths import kernel, with_neighbours
from filigrane.session import checkpointed

RING = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))


def pad(px: DataFrame, axis: str, size: str, reach: int, mode: str) -> DataFrame:
    """Copies of border pixels beyond both ends of an axis, so that a stencil of that reach finds its rows. mode:
    reflect (the edge pixel repeats once, then mirrored) or nearest. Copies carry _pad."""
    if mode == "reflect":
        far = f"cast({reach} div (2 * {size}) + 1 as int)"  # as many mirror images as the stencil reaches
        turns = f"sequence(-{far}, {far})"
        pos = (f"filter(flatten(transform({turns}, m -> array({axis} + 2 * {size} * m, -1 - {axis} + 2 * {size} * m))), "
               f"e -> e >= -{reach} and e < {size} + {reach})")
    else:
        pos = (f"concat(array({axis}), case when {axis} = 0 then sequence(-{reach}L, -1L) else array() end, "
               f"case when {axis} = {size} - 1 then sequence(cast({size} as long), cast({size} as long) + {reach} - 1) "
               f"else array() end)")
    return px.withColumn("_e", F.explode(F.expr(pos))).withColumn("_pad", F.expr(f"_e <> {axis}"))


def convolve(px: DataFrame, cols: dict, axis: str, size: str, mode: str = "reflect") -> DataFrame:
    """One pass of a separable stencil along an axis: cols {out: (column, [(offset, weight), ...])}. One shuffle by
    (image, line, stretch of the line); no row is copied per kernel tap."""
    other = "x" if axis == "y" else "y"
    reach = max(abs(o) for _, k in cols.values() for o, _ in k)
    d = pad(px, axis, size, reach, mode)
    src = sorted({c for c, _ in cols.values()})
    offs = sorted({o for _, k in cols.values() for o, _ in k if o})
    d = with_neighbours(d.select(*px.columns, "_e", "_pad"), ["image_id", other], src, offs, "_e").where("not _pad")

    def at(c, o):
        return c if o == 0 else f"{c}_{'m' if o < 0 else 'p'}{abs(o)}"
    made = [F.expr(" + ".join(f"{w!r}D * {at(c, o)}" for o, w in k)).alias(out) for out, (c, k) in cols.items()]
    return d.select(*px.columns, *made)


def gaussian(px: DataFrame, col: str, sigma: float, w: str, h: str, out: str, mode: str = "reflect") -> DataFrame:
    """Separable Gaussian of a column."""
    d = convolve(px, {"_gx": (col, kernel(sigma))}, "x", w, mode)
    return convolve(d, {out: ("_gx", kernel(sigma))}, "y", h, mode).drop("_gx")


def difference_of_gaussians(px: DataFrame, col: str, sigma: float, w: str, h: str, out: str) -> DataFrame:
    """Band between sigma and 2 sigma."""
    d = convolve(px, {"_a": (col, kernel(sigma)), "_b": (col, kernel(2 * sigma))}, "x", w)
    d = convolve(d, {"_aa": ("_a", kernel(sigma)), "_bb": ("_b", kernel(2 * sigma))}, "y", h)
    return d.withColumn(out, F.expr("_aa - _bb")).drop("_a", "_b", "_aa", "_bb")


def hessian(px: DataFrame, col: str, s: float, w: str, h: str) -> DataFrame:
    """Strength of dark (dark) and bright (bright) lines at a scale and the direction across (phi)."""
    k = [kernel(s, o) for o in (0, 1, 2)]
    d = convolve(px, {"_0": (col, k[0]), "_1": (col, k[1]), "_2": (col, k[2])}, "x", w)
    d = convolve(d, {"_xx": ("_2", k[0]), "_yy": ("_0", k[2]), "_xy": ("_1", k[1])}, "y", h)
    d = d.withColumn("_tr", F.expr("0.5D * (_xx + _yy)")).withColumn(
        "_di", F.expr("sqrt(power(0.5D * (_xx - _yy), 2) + _xy * _xy)"))
    return d.selectExpr(*px.columns, f"{s * s!r}D * greatest(_tr + _di - abs(_tr - _di), 0.0D) as dark",
                        f"{s * s!r}D * greatest(-(_tr - _di) - abs(_tr + _di), 0.0D) as bright",
                        "0.5D * atan2(2 * _xy, _xx - _yy) as phi")


def laplacian(px: DataFrame, col: str, w: str, h: str, out: str = "lap") -> DataFrame:
    """Five-point Laplacian, borders reflected."""
    d = convolve(px, {"_lx": (col, [(-1, 1.0), (0, -4.0), (1, 1.0)])}, "x", w)
    return convolve(d.withColumn("_v", F.col(col)), {"_ly": ("_v", [(-1, 1.0), (1, 1.0)])}, "y", h).withColumn(
        out, F.expr("_lx + _ly")).drop("_lx", "_ly", "_v")


def neighbours_of(px: DataFrame, offsets, ident: str = "pid") -> DataFrame:
    """(image_id, src, dst, dy, dx) of pixels at the given offsets, by equality on the shifted position."""
    off = ", ".join(f"struct({dy}L as dy, {dx}L as dx)" for dy, dx in offsets)
    a = px.selectExpr("image_id", "y", "x", f"{ident} as src", f"explode(array({off})) as o").selectExpr(
        "image_id", "y + o.dy as y", "x + o.dx as x", "src", "o.dy as dy", "o.dx as dx")
    return a.join(px.selectExpr("image_id", "y", "x", f"{ident} as dst"), ["image_id", "y", "x"]).select(
        "image_id", "src", "dst", "dy", "dx")


def label(px: DataFrame, eight: bool = True, ident: str = "pid") -> DataFrame:
    """Pixels with the smallest pixel number of their connected component."""
    half = ((0, 1), (1, -1), (1, 0), (1, 1)) if eight else ((0, 1), (1, 0))
    px = checkpointed(px)
    c = connected_components(neighbours_of(px, half, ident).select("src", "dst"), px.selectExpr(f"{ident} as node"))
    return px.join(c.selectExpr(f"node as {ident}", "comp"), ident)


def skeleton_links(sk: DataFrame) -> DataFrame:
    """Both directions of the pixel graph: 8-neighbours, without diagonals whose two pixels share a 4-neighbour."""
    n = checkpointed(neighbours_of(sk, RING))
    straight = n.where("dy = 0 or dx = 0").selectExpr("src", "dst as mid")
    both = (straight.join(straight.selectExpr("mid", "src as dst"), "mid").select("src", "dst").where("src <> dst")
            .distinct())
    diag = n.where("dy <> 0 and dx <> 0").join(both, ["src", "dst"], "left_anti")
    return n.where("dy = 0 or dx = 0").unionByName(diag.select(n.columns))


def crowding(sk: DataFrame) -> DataFrame:
    """Skeleton pixels with their number of 8-neighbours."""
    n = neighbours_of(sk, RING).groupBy(F.col("src").alias("pid")).agg(F.count(F.lit(1)).alias("nb"))
    return sk.join(n, "pid", "left").na.fill(0, ["nb"])


def dilate(px: DataFrame, r: int = 1) -> DataFrame:
    """Positions within r pixels (square) of the given ones."""
    return px.selectExpr("image_id", f"explode(sequence(y - {r}, y + {r})) as y", "x").selectExpr(
        "image_id", "y", f"explode(sequence(x - {r}, x + {r})) as x").distinct()


def branches(sk: DataFrame) -> DataFrame:
    """Skeleton less the dilated junction pixels, labelled: pid, comp, nb, touches (next to that zone)."""
    c = checkpointed(crowding(sk))
    zone = checkpointed(dilate(c.where("nb >= 3")))
    br = label(c.join(zone, ["image_id", "y", "x"], "left_anti"))
    near = dilate(zone).withColumn("_n", F.lit(True))
    return br.join(near, ["image_id", "y", "x"], "left").withColumn("touches", F.expr("_n is not null")).drop("_n")


def spur_pixels(sk: DataFrame, min_len: float = 8.0) -> DataFrame:
    """Pixels of branches that end free, touch a junction and are shorter than min_len."""
    b = checkpointed(branches(sk))
    spur = b.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.expr("bool_or(nb = 1)").alias("free"),
                                 F.expr("bool_or(touches)").alias("at")).where(f"free and at and n < {min_len}")
    return b.join(spur.select("comp"), "comp", "left_semi").select("image_id", "pid", "y", "x")


def enclosed(px: DataFrame, flag: str, w: str, h: str, min_area: int) -> DataFrame:
    """4-connected regions of pixels without `flag` that do not touch the border: comp, image_id, area."""
    b = label(px.where(f"not ({flag})"), eight=False)
    return (b.groupBy("image_id", "comp").agg(F.count(F.lit(1)).alias("area"), F.expr(
        f"bool_or(y = 0 or x = 0 or y = {h} - 1 or x = {w} - 1)").alias("border"))
        .where(f"not border and area >= {min_area}").drop("border"))


def hysteresis(px: DataFrame, weak: str, strong: str, min_size: int = 0) -> DataFrame:
    """Components of weak pixels that hold a strong one and are larger than min_size."""
    b = checkpointed(label(px.where(weak)))
    ok = b.groupBy("comp").agg(F.expr(f"bool_or({strong})").alias("s"), F.count(F.lit(1)).alias("n")).where(
        f"s and n > {min_size}")
    return b.join(ok.select("comp"), "comp", "left_semi")


def disc(pts: DataFrame, r: str, w: int, h: int) -> DataFrame:
    """Pixels (y, x) within r of every point (columns px, py, and what else it has), inside the frame."""
    d = pts.selectExpr("*", f"explode(sequence(cast(ceil(py - {r}) as long), cast(floor(py + {r}) as long))) as y")
    d = d.selectExpr("*", f"explode(sequence(cast(ceil(px - {r}) as long), cast(floor(px + {r}) as long))) as x")
    return d.where(f"power(px - x, 2) + power(py - y, 2) <= power({r}, 2) and y between 0 and {h - 1} "
                   f"and x between 0 and {w - 1}")
