"""Corpus statistics and the comparison of one set of images with another.

All tables are long: (image_id, set, site, key, value). Every step is a partial aggregation by key.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigrane import tables as T
from filigrane.operators.quantile import quantiles, value_bins
from filigrane.operators.scan import running
from filigrane.session import checkpointed


def summarise(stats: DataFrame, keys=("key",)) -> DataFrame:
    """Mean, sample SD, min, max and count of the values of every key; NULLs do not count."""
    return stats.where("value is not null").groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.expr("stddev_samp(value)").alias("sd"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.count("value").alias("n"))


def _sides(stats: DataFrame, by, cond: dict) -> DataFrame:
    aggs = []
    for name, c in cond.items():
        v = f"case when {c} then value end"
        aggs += [F.expr(f"avg({v})").alias(f"{name}_mean"), F.expr(f"stddev_samp({v})").alias(f"{name}_sd"),
                 F.expr(f"min({v})").alias(f"{name}_min"), F.expr(f"max({v})").alias(f"{name}_max"),
                 F.expr(f"count({v})").alias(f"n_{name}")]
    return stats.groupBy(*by).agg(*aggs)


def scorecard(stats: DataFrame, catalogue: DataFrame, by=(), z_max: float = T.Z_MAX) -> DataFrame:
    """One row per key of the catalogue (and per `by` group): real and synthetic summary, z of the synthetic mean,
    inside the real range, passed. NULL where fewer than three real values exist; failed where none is synthetic."""
    by = list(by)
    s = _sides(stats, by + ["key"], {"real": "set = 'real'", "syn": "set = 'synthetic'"})
    j = s.join(catalogue, "key") if by else catalogue.join(s, "key", "left")
    return (j.withColumn("n_real", F.coalesce("n_real", F.lit(0))).withColumn("n_syn", F.coalesce("n_syn", F.lit(0)))
            .withColumn("z", F.expr("""
                case when n_real < 3 or n_syn = 0 then null
                     when real_sd > 0 then (syn_mean - real_mean) / real_sd
                     when syn_mean = real_mean then 0.0D
                     else sign(syn_mean - real_mean) * double('infinity') end"""))
            .withColumn("inside", F.expr("""
                case when n_real < 3 then null when n_syn = 0 then false
                     else syn_mean between real_min and real_max end"""))
            .withColumn("passed", F.expr(f"case when n_real < 3 then null when n_syn = 0 then false "
                                         f"else inside and abs(z) <= {z_max} end")))


def score_breakdown(card: DataFrame) -> DataFrame:
    """Passed, scored and far counts per tier and overall (tier NULL)."""
    return (card.where("passed is not null").rollup("tier")
            .agg(F.expr("count_if(passed)").alias("n_pass"), F.count(F.lit(1)).alias("n_scored"),
                 F.expr("count_if(z is null or abs(z) > 4)").alias("n_far")))


def compare_sets(stats: DataFrame, dense: str = "site = 0") -> DataFrame:
    """Real (pooled and dense site) against synthetic per key, with z against both, the range test and whether the
    sets separate."""
    s = _sides(stats, ["key"], {"real": "set = 'real'", "dense": f"set = 'real' and {dense}",
                                "syn": "set = 'synthetic'"})

    def z(ref):
        return F.expr(f"case when n_{ref} < 2 or n_syn = 0 or {ref}_sd <= 0 then null "
                      f"else (syn_mean - {ref}_mean) / {ref}_sd end")
    return (s.withColumn("z_pooled", z("real")).withColumn("z_dense", z("dense"))
            .withColumn("in_dense", F.expr("coalesce(n_dense > 0 and n_syn > 0 and "
                                           "syn_mean between dense_min and dense_max, false)"))
            .withColumn("separates", separates("dense")))


def separates(ref: str, z_min: float = 3.0):
    """yes: more than z_min SDs away and the ranges apart; partly: one of the two; no; n/a: too few values."""
    far = (f"case when {ref}_sd > 0 then abs(syn_mean - {ref}_mean) / {ref}_sd > {z_min} "
           f"else syn_mean <> {ref}_mean end")
    apart = f"(syn_max < {ref}_min or syn_min > {ref}_max)"
    return F.expr(f"case when n_{ref} < 2 or n_syn = 0 then 'n/a' when ({far}) and {apart} then 'yes' "
                  f"when ({far}) or {apart} then 'partly' else 'no' end")


def curve_distances(curves: DataFrame, how: str, group=("dist",), at: str = "level") -> DataFrame:
    """Distances of curves (image_id, set, *group, at, q): every real curve to the mean of the other real ones and
    every synthetic curve to the mean of all real ones. how: 'abs' mean absolute, 'rms' root mean square.
    Leave-one-out means come from sums, so no curve meets another in a join."""
    g = list(group)
    total = (curves.where("set = 'real'").groupBy(*g, at)
             .agg(F.sum("q").alias("_s"), F.count("q").alias("_n")))
    d = curves.join(total, g + [at]).withColumn("_d", F.expr(
        "q - case when set = 'real' then (_s - q) / (_n - 1) else _s / _n end"))
    dist = "avg(abs(_d))" if how == "abs" else "sqrt(avg(_d * _d))"
    return d.groupBy(*g, "image_id", "set").agg(F.expr(dist).alias("distance"), F.avg("_d").alias("shift"))


def curve_gate(distances: DataFrame, group=("dist",), min_real: int = 3) -> DataFrame:
    """Median and 95th percentile of the real-to-real distances, mean synthetic distance, their ratio, bias and
    whether the synthetic mean stays within the gate."""
    g = list(group)
    rr = quantiles(distances.where("set = 'real'"), g, "distance", {"rr_med": 0.5, "rr_p95": 0.95}, count="n_real")
    syn = distances.where("set = 'synthetic'").groupBy(*g).agg(F.avg("distance").alias("syn_mean"),
                                                               F.avg("shift").alias("bias"))
    return (rr.where(f"n_real >= {min_real}").join(syn, g, "left")
            .withColumn("ratio", F.expr("case when rr_p95 > 0 then syn_mean / rr_p95 end"))
            .withColumn("passed", F.expr("coalesce(syn_mean <= rr_p95, false)")))


def average_ranks(df: DataFrame, keys, value: str, name: str, weight: str = "1L") -> DataFrame:
    """keys, value, name: average rank of every distinct value in its group, counted up from a histogram so that no
    group is sorted in one task. A row counts `weight` times."""
    keys = list(keys)
    base = df.where(f"{value} is not null").groupBy(*keys, value).agg(F.sum(F.expr(weight)).alias("_w"))
    r = running(value_bins(base, keys, value, "_w"), keys, [value], "_b", {"_cum": ("sum", "_w")})
    return r.selectExpr(*keys, value, f"_cum - (_w - 1) / 2.0D as {name}")


def spearman(df: DataFrame, keys, a: str, b: str, name: str = "rho") -> DataFrame:
    """Correlation of the average ranks, from the distinct pairs of values and how often they occur."""
    keys = list(keys)
    d = checkpointed(df.where(f"{a} is not null and {b} is not null").groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("_m")))
    ra, rb = average_ranks(d, keys, a, "_ra", "_m"), average_ranks(d, keys, b, "_rb", "_m")
    mid = d.groupBy(*keys).agg(F.expr("(sum(_m) + 1) / 2.0D").alias("_mid"))  # the mean of any n average ranks
    j = (d.join(ra, keys + [a]).join(rb, keys + [b]).join(mid, keys)
         .withColumn("_x", F.expr("_ra - _mid")).withColumn("_y", F.expr("_rb - _mid")))
    return j.groupBy(*keys).agg(F.expr("sum(_m * _x * _y) / nullif(sqrt(sum(_m * _x * _x) * sum(_m * _y * _y)), 0)").alias(name),
                                F.sum("_m").alias("n"))


def top_by(df: DataFrame, keys, order: list, n: int) -> DataFrame:
    """The first n rows per group: each task keeps its own first n before the group comes together."""
    keys = list(keys)
    pre = Window.partitionBy(*keys, "_part").orderBy(*order)
    fin = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_part", F.expr(f"pmod(xxhash64({', '.join(df.columns)}), 64)"))
    return (d.withColumn("_r", F.row_number().over(pre)).where(f"_r <= {n}")
            .withColumn("rank", F.row_number().over(fin).cast("long")).where(f"rank <= {n}").drop("_r", "_part"))
