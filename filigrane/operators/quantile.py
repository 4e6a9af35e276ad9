"""Exact quantiles of groups of any size.

The built-in `percentile` keeps all distinct values of a group in one task. Here the values of all groups are sorted in parts of
bounded size, whose counts say in which part a rank lies.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigrane.operators.scan import batch_counted, parts
from filigrane.session import checkpointed

BINS = 1024


def value_bins(base: DataFrame, keys, value: str, weight: str) -> DataFrame:
    """base with `_b`, a bin number that never decreases with the value, and `_n`, the weight of the group. Bins are of
    equal width, twice: each first bin is cut again between the values it really has, so that a far outlier or a heavy
    tail does not leave all other values in one bin."""
    keys = list(keys)

    def bin_of(lo, hi):
        return (f"case when {hi} > {lo} then cast(least(floor(({value} - {lo}) / ({hi} - {lo}) * {BINS}), {BINS - 1}) as long) "
                f"else 0L end")
    span = base.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum(weight).alias("_n"))
    first = base.join(span, keys).withColumn("_b", F.expr(bin_of("_lo", "_hi"))).drop("_lo", "_hi")
    inner = first.groupBy(*keys, "_b").agg(F.min(value).alias("_l2"), F.max(value).alias("_h2"))
    return (first.join(inner, keys + ["_b"]).withColumn("_b", F.expr(f"_b * {BINS} + {bin_of('_l2', '_h2')}"))
            .drop("_l2", "_h2"))


def ordered(df: DataFrame, keys, value: str) -> tuple[DataFrame, int]:
    """keys, _v, _w (a weight; a value may have several rows) and _part, which never decreases along (keys, _v), and the number of parts,
    which follows that of the rows. Equal values are counted batch by batch first, so that a frequent one does not fill a part. Written:
    another run of the sort may set other bounds."""
    keys = list(keys)
    base = checkpointed(batch_counted(df.select(*keys, F.expr(value).cast("double").alias("_v")).where("_v is not null")))
    n = parts(base)
    return checkpointed(base.repartitionByRange(n, *keys, "_v").withColumn("_part", F.spark_partition_id())), n


def part_starts(rows: DataFrame, keys) -> DataFrame:
    """keys, _part, _m (weight there), _start (weight of the group's parts before), _n (weight of the group)."""
    w = Window.partitionBy(*keys)
    before = w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.groupBy(*keys, "_part").agg(F.sum("_w").alias("_m"))
            .select(*keys, "_part", "_m", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"), F.sum("_m").over(w).alias("_n")))


def positions(rows: DataFrame, n: int, keys) -> DataFrame:
    """rows with _at, the weight before them in their group and part. The shuffle has as many parts as the sort."""
    w = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return rows.repartition(n, *keys, "_part").withColumn("_at", F.sum("_w").over(w) - F.col("_w"))


def rank_values(df: DataFrame, keys, value: str, probs) -> DataFrame:
    """keys, _n, _rank, _v: the values at the ranks around p * (n - 1) for every p of probs."""
    keys = list(keys)
    rows, n = ordered(df, keys, value)
    ranks = ", ".join(f"floor({p!r} * (_n - 1)), ceil({p!r} * (_n - 1))" for p in probs)
    wanted = (part_starts(rows, keys)
              .withColumn("_ranks", F.expr(f"filter(array_distinct(array({ranks})), r -> r >= _start and r < _start + _m)"))
              .where("size(_ranks) > 0").drop("_m"))
    hit = positions(rows, n, keys).join(wanted.hint("merge"), keys + ["_part"])
    return (hit.withColumn("_rank", F.explode(F.expr("filter(_ranks, r -> r >= _start + _at and r < _start + _at + _w)")))
            .select(*keys, "_n", "_rank", "_v"))


def _at(p: float) -> str:
    lo = f"max(case when _rank = floor({p!r} * (_n - 1)) then _v end)"
    hi = f"max(case when _rank = ceil({p!r} * (_n - 1)) then _v end)"
    frac = f"({p!r} * (max(_n) - 1) - floor({p!r} * (max(_n) - 1)))"
    return f"{lo} + ({hi} - {lo}) * {frac}"


def quantiles(df: DataFrame, keys, value: str, probs: dict, count: str | None = None) -> DataFrame:
    """Linearly interpolated quantiles {name: p} of `value` per group (NULLs ignored), one row per group with a
    value."""
    got = rank_values(df, keys, value, list(probs.values()))
    aggs = [F.expr(_at(p)).alias(n) for n, p in probs.items()]
    if count:
        aggs.append(F.max("_n").alias(count))
    return got.groupBy(*keys).agg(*aggs)


def quantile_levels(df: DataFrame, keys, value: str, levels, min_n: int = 1) -> DataFrame:
    """Long form for many levels: keys, level (index), q; groups with fewer than min_n values left out. The wanted
    ranks are merged into the ordered values of the part they lie in and take the latest value before them."""
    keys = list(keys)
    rows, n = ordered(df, keys, value)
    starts = part_starts(rows, keys).where(f"_n >= {min_n}")
    arr = ", ".join(f"{p!r}D" for p in levels)
    wanted = (starts.selectExpr("*", f"posexplode(array({arr})) as (level, _q)")
              .selectExpr("*", "_q * (_n - 1) as _p", "explode(array(floor(_q * (_n - 1)), ceil(_q * (_n - 1)))) as _rank")
              .where("_rank >= _start and _rank < _start + _m"))
    both = (positions(rows, n, keys).select(*keys, "_part", "_at", "_v", F.expr("0 as _kind"), F.expr("cast(null as int) as level"),
                                            F.expr("cast(null as double) as _p"))
            .unionByName(wanted.select(*keys, "_part", F.expr("_rank - _start as _at"), F.expr("cast(null as double) as _v"),
                                       F.expr("1 as _kind"), "level", "_p")))
    w = Window.partitionBy(*keys, "_part").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    got = (both.repartition(n, *keys, "_part").withColumn("_val", F.last("_v", ignorenulls=True).over(w)).where("_kind = 1")
           .select(*keys, "level", "_p", "_val"))
    return got.repartition(n, *keys).groupBy(*keys, "level").agg(F.expr(
        "min(_val) + (max(_val) - min(_val)) * (max(_p) - floor(max(_p)))").alias("q"))


def median_abs_dev(df: DataFrame, keys, value: str, name: str = "mad", med: str = "med") -> DataFrame:
    """keys, med, mad: median and median absolute deviation (two exact selections)."""
    keys = list(keys)
    m = checkpointed(quantiles(df, keys, value, {med: 0.5}))
    d = df.select(*keys, F.expr(value).cast("double").alias("_x")).join(m, keys)
    return m.join(quantiles(d, keys, f"abs(_x - {med})", {name: 0.5}), keys)


def uniform(n: int, lo: float, hi: float):
    return [lo + (hi - lo) * k / (n - 1) for k in range(n)] if n > 1 else [lo]


Q_LEVELS = uniform(100, 0.005, 0.995)
assert math.isclose(Q_LEVELS[-1], 0.995)
