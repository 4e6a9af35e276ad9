"""Measures along ordered points (keys, pos, x, y)."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigrane.operators.scan import CHUNK, halo, own, running


def with_neighbours(df: DataFrame, keys, cols, offsets, pos="i", hold: bool = False) -> DataFrame:
    """Columns <col>_m<k> / <col>_p<k> from the rows k before / after; with `hold` the first and last row repeat."""
    reach = max(abs(o) for o in offsets)
    d = halo(df, reach + 1, pos)
    w = Window.partitionBy(*keys, "_c").orderBy(pos)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = ["*"]
    for c in cols:
        for o in offsets:
            v = F.lag(c, -o).over(w) if o < 0 else F.lead(c, o).over(w)
            if hold:
                v = F.coalesce(v, (F.first(c) if o < 0 else F.last(c)).over(full))
            out.append(v.alias(f"{c}_{'m' if o < 0 else 'p'}{abs(o)}"))
    return own(d.select(*out))


def arclength(df: DataFrame, keys, pos="i", out="arc") -> DataFrame:
    """Cumulative length along the points."""
    d = with_neighbours(df, keys, ["x", "y"], [-1], pos).withColumn(
        "_step", F.expr("coalesce(sqrt(power(x - x_m1, 2) + power(y - y_m1, 2)), 0.0D)"))
    d = d.withColumn("_ck", F.expr(f"{pos} div {CHUNK}"))
    return running(d, keys, [pos], "_ck", {out: ("sum", "_step")}).drop("_ck", "_step", "x_m1", "y_m1")


def kernel(sigma: float, order: int = 0):
    """Normalised Gaussian weights at offsets -r..r, r = round(4 sigma); order 1 or 2: its derivative as a
    correlation kernel."""
    r = int(4.0 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    tot = sum(w)
    w = [v / tot for v in w]
    if order == 1:
        w = [v * k / sigma ** 2 for v, k in zip(w, range(-r, r + 1))]
    elif order == 2:
        w = [v * (k * k / sigma ** 2 - 1) / sigma ** 2 for v, k in zip(w, range(-r, r + 1))]
    return list(zip(range(-r, r + 1), w))


def smooth(df: DataFrame, keys, cols, sigma: float, pos="i", suffix="_s") -> DataFrame:
    """Gaussian smoothing along the points; the end values are held."""
    k = kernel(sigma)
    offs = [o for o, _ in k if o]
    d = with_neighbours(df, keys, cols, offs, pos, hold=True)
    made = []
    for c in cols:
        terms = [f"{w!r}D * {c}" + ("" if o == 0 else f"_{'m' if o < 0 else 'p'}{abs(o)}") for o, w in k]
        made.append(F.expr(" + ".join(terms)).alias(f"{c}{suffix}"))
    return d.select(*df.columns, *made)


def resample(df: DataFrame, keys, step: float, cols=("x", "y"), pos="i", arc="arc") -> DataFrame:
    """Points every `step` of arclength. Every segment lists the steps that fall on it, so no path is gathered."""
    d = with_neighbours(df, keys, [arc, *cols], [1], pos).where(f"{arc}_p1 > {arc}")
    d = d.withColumn("k", F.explode(F.expr(
        f"case when ceil({arc}_p1 / {step}) > ceil({arc} / {step}) "
        f"then sequence(ceil({arc} / {step}), ceil({arc}_p1 / {step}) - 1) else array() end")))
    t = f"(k * {step} - {arc}) / ({arc}_p1 - {arc})"
    return d.selectExpr(*keys, "k", f"k * {step} as s", *[f"{c} + {t} * ({c}_p1 - {c}) as {c}" for c in cols])


def densify(df: DataFrame, keys, step: float, pos="k") -> DataFrame:
    """Points at most `step` apart along polylines: evenly spaced on every segment, plus the last vertex."""
    d = with_neighbours(df, keys, ["x", "y"], [1], pos)
    d = d.withColumn("_n", F.expr(
        f"case when x_p1 is null then 1 else greatest(1, cast(ceil(sqrt(power(x_p1 - x, 2) + power(y_p1 - y, 2)) "
        f"/ {step}) as int)) end")).withColumn("m", F.explode(F.expr("sequence(0, _n - 1)")))
    return d.selectExpr(*keys, pos, "m", "case when x_p1 is null then x else x + m / _n * (x_p1 - x) end as x",
                        "case when y_p1 is null then y else y + m / _n * (y_p1 - y) end as y")


def interpolate(curve: DataFrame, targets: DataFrame, keys, at: str, value: str, out: str) -> DataFrame:
    """Linear interpolation of `value` over `at` for every target row, constant beyond the ends. The targets are
    merged into the curve and look at the nearest curve row on both sides."""
    keys = list(keys)
    extra = [c for c in targets.columns if c not in keys and c != at]
    c = curve.selectExpr(*keys, f"cast({at} as double) as _at", "0 as _kind",
                         f"struct(cast({at} as double) as s, cast({value} as double) as v) as _pt",
                         "cast(null as struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}"
                                                           for f in targets.schema if f.name in extra)
                         + ">) as _row" if extra else "cast(null as int) as _row")
    t = targets.selectExpr(*keys, f"cast({at} as double) as _at", "1 as _kind",
                           "cast(null as struct<s:double,v:double>) as _pt",
                           f"struct({', '.join(extra)}) as _row" if extra else "cast(null as int) as _row")
    u = c.unionByName(t).withColumn("_ck", F.expr(f"cast(floor(_at / {CHUNK}) as long)"))
    u = running(u, keys, ["_at", "_kind"], "_ck", {"_lo": ("last", "_pt"), "_hi": ("last", "_pt", "back")})
    u = u.where("_kind = 1").withColumn(out, F.expr(
        "case when _lo is null then _hi.v when _hi is null or _hi.s = _lo.s then _lo.v "
        "else _lo.v + (_at - _lo.s) / (_hi.s - _lo.s) * (_hi.v - _lo.v) end"))
    return u.selectExpr(*keys, f"_at as {at}", *([f"_row.{e} as {e}" for e in extra]), out)
