"""Queries over image statistics and profiles: summaries, scorecards, distances between corpora."""
from __future__ import annotations

from pyspark.sql import functions as F

from filigrane.operators import scorecard as S
from filigrane.operators.quantile import Q_LEVELS, median_abs_dev, quantile_levels, quantiles
from filigrane.plans import oracle
from filigrane.plans.registry import query
from filigrane.session import checkpointed
from filigrane.sources import views as V

CARD_SQL = """
 select k.key, k.tier, coalesce(n_real, 0) as n_real, coalesce(n_syn, 0) as n_syn, real_mean, real_sd, real_min,
   real_max, syn_mean, syn_sd, syn_min, syn_max,
   case when coalesce(n_real, 0) < 3 or coalesce(n_syn, 0) = 0 then null
        when real_sd > 0 then (syn_mean - real_mean) / real_sd when syn_mean = real_mean then 0.0
        else sign(syn_mean - real_mean) * 'infinity'::double end as z,
   case when coalesce(n_real, 0) < 3 then null when n_syn = 0 then false
        else syn_mean between real_min and real_max end as inside
 from stat_keys k left join (
   select key, avg(value) filter ("set" = 'real') real_mean, stddev_samp(value) filter ("set" = 'real') real_sd,
     min(value) filter ("set" = 'real') real_min, max(value) filter ("set" = 'real') real_max,
     count(value) filter ("set" = 'real') n_real,
     avg(value) filter ("set" = 'synthetic') syn_mean, stddev_samp(value) filter ("set" = 'synthetic') syn_sd,
     min(value) filter ("set" = 'synthetic') syn_min, max(value) filter ("set" = 'synthetic') syn_max,
     count(value) filter ("set" = 'synthetic') n_syn
   from image_stats group by key) s on s.key = k.key"""
oracle.define("card", ("image_stats", "stat_keys"), CARD_SQL)
oracle.define("card_passed", ("card",), """
 select *, case when n_real < 3 then null when n_syn = 0 then false else inside and abs(z) <= 2 end as passed
 from card""")


def _card(spark, sf):
    return S.scorecard(V.image_stats(spark, sf), V.stat_keys(spark, sf))


ROUNDED = ("real_mean", "real_sd", "real_min", "real_max", "syn_mean", "syn_sd", "syn_min", "syn_max", "z")
R = ", ".join(f"round({c}, 6) as {c}" for c in ROUNDED)


@query("sta01_scorecard", "card_passed", f"select key, cast(tier as bigint) tier, n_real, n_syn, {R}, inside, passed "
                                         "from card_passed")
def sta01(spark, sf):
    return _card(spark, sf).selectExpr("key", "cast(tier as bigint) as tier", "n_real", "n_syn",
                                       *[f"round({c}, 6) as {c}" for c in ROUNDED], "inside", "passed")


@query("agg14_reference_summary", "image_stats", """
 select key, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, round(min(value), 6) as min,
   round(max(value), 6) as max, count(value) as n from image_stats where "set" = 'real' group by key""")
def agg14(spark, sf):
    s = S.summarise(V.image_stats(spark, sf).where("set = 'real'"))
    return s.selectExpr("key", *[f"round({c}, 6) as {c}" for c in ("mean", "sd", "min", "max")], "n")


@query("agg15_summary_by_site", "image_stats", """
 select key, site, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, round(min(value), 6) as min,
   round(max(value), 6) as max, count(value) as n from image_stats where "set" = 'real'
 group by grouping sets ((key), (key, site))""")
def agg15(spark, sf):
    d = V.image_stats(spark, sf).where("set = 'real'")
    d.createOrReplaceTempView("_agg15_stats")
    return spark.sql("""
      select key, site, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, round(min(value), 6) as min,
        round(max(value), 6) as max, count(value) as n
      from _agg15_stats group by grouping sets ((key), (key, site))""")


@query("agg16_median_min_max", "profiles", """
 select quantity, round(median(v), 6) as median, min(v) as min, max(v) as max
 from (unpivot profiles on contrast, fwhm, edge into name quantity value v) group by quantity""")
def agg16(spark, sf):
    long = (V.profiles(spark, sf).select("contrast", "fwhm", "edge")
            .unpivot([], ["contrast", "fwhm", "edge"], "quantity", "v"))
    m = quantiles(long, ["quantity"], "v", {"median": 0.5})
    r = long.groupBy("quantity").agg(F.min("v").alias("min"), F.max("v").alias("max"))
    return m.join(r, "quantity").selectExpr("quantity", "round(median, 6) as median", "min", "max")


@query("agg17_score_breakdown", "card_passed", """
 select cast(tier as bigint) as tier, count(*) filter (passed) as n_pass, count(*) as n_scored,
   count(*) filter (z is null or abs(z) > 4) as n_far
 from card_passed where passed is not null group by rollup (tier)""")
def agg17(spark, sf):
    return S.score_breakdown(_card(spark, sf)).withColumn("tier", F.col("tier").cast("long"))


DISTS = {"contrast": "contrast", "log FWHM": "ln(fwhm)", "log edge width": "ln(edge)", "log FWHM/edge": "ln(sharp)"}


def _dists(spark, sf):
    parts = ", ".join(f"'{n}', cast({e} as double)" for n, e in DISTS.items())
    return V.profiles(spark, sf).selectExpr(
        "image_id", "case when image_id % 5 = 0 then 'synthetic' else 'real' end as set",
        f"stack({len(DISTS)}, {parts}) as (dist, v)")


LEV = ", ".join(repr(p) for p in Q_LEVELS)
oracle.define("dists", ("profiles",), " union all ".join(
    f"""select image_id, case when image_id % 5 = 0 then 'synthetic' else 'real' end as "set", '{n}' as dist,
        {e} as v from profiles""" for n, e in DISTS.items()))
oracle.define("qf", ("dists",), f"""
  select image_id, "set", dist, l as level, qs[l + 1] as q from (
    select image_id, "set", dist, quantile_cont(v, [{LEV}]) as qs, unnest(range(100)) as l
    from dists group by image_id, "set", dist having count(v) >= 20)""")


def _qf(spark, sf):
    return quantile_levels(_dists(spark, sf), ["image_id", "set", "dist"], "v", Q_LEVELS, min_n=20)


@query("sta02_quantile_functions", "qf",
       'select image_id, dist, cast(level as bigint) as level, round(q, 6) as q from qf')
def sta02(spark, sf):
    return _qf(spark, sf).selectExpr("image_id", "dist", "cast(level as bigint) as level", "round(q, 6) as q")


GATE_SQL = """
  select dist, n_real, round(rr_med, 6) as rr_med, round(rr_p95, 6) as rr_p95, round(syn_mean, 6) as syn_mean,
    round(case when rr_p95 > 0 then syn_mean / rr_p95 end, 6) as ratio, round(bias, 6) as bias,
    coalesce(syn_mean <= rr_p95, false) as passed
  from (select dist, median(d) filter ("set" = 'real') as rr_med,
      quantile_cont(d, 0.95) filter ("set" = 'real') as rr_p95,
      avg(d) filter ("set" = 'synthetic') as syn_mean, avg(s) filter ("set" = 'synthetic') as bias,
      count(*) filter ("set" = 'real') as n_real
    from dd group by dist) where n_real >= 3"""


@query("sta03_wasserstein", "qf", """,
  tot as (select dist, level, sum(q) s, count(q) n from qf where "set" = 'real' group by dist, level),
  dd as (select qf.dist, image_id, "set",
      avg(abs(q - case when "set" = 'real' then (s - q) / (n - 1) else s / n end)) as d,
      avg(q - case when "set" = 'real' then (s - q) / (n - 1) else s / n end) as s
    from qf join tot on tot.dist = qf.dist and tot.level = qf.level group by qf.dist, image_id, "set")
  """ + GATE_SQL)
def sta03(spark, sf):
    g = S.curve_gate(checkpointed(S.curve_distances(checkpointed(_qf(spark, sf)), "abs")))
    return g.selectExpr("dist", "n_real", *[f"round({c}, 6) as {c}" for c in ("rr_med", "rr_p95", "syn_mean", "ratio",
                                                                            "bias")], "passed")


oracle.define("psd", (), """
  select vec_id as image_id, case when label = 0 then 'synthetic' else 'real' end as "set", label,
    (p + 1) / 128.0 as f, cast(embedding[p + 1] as double) * cast(embedding[p + 1] as double) + 1e-6 as p
  from (select *, unnest(range(len(embedding))) as p from embeddings)""")


def _psd(spark, sf):
    return V.table(spark, sf, "embeddings").selectExpr(
        "vec_id as image_id", "case when label = 0 then 'synthetic' else 'real' end as set", "label",
        "posexplode(embedding) as (i, e)").selectExpr(
        "image_id", "set", "label", "(i + 1) / 128.0D as f", "cast(e as double) * cast(e as double) + 1e-6D as p")


BAND_CASE = ("case when f >= 1 / 128.0{d} and f < 1 / 16.0{d} then '1/128-1/16' "
             "when f >= 1 / 16.0{d} and f < 0.25{d} then '1/16-1/4' when f >= 0.25{d} and f < 0.51{d} then '1/4-1/2' end")


@query("sta04_spectra", "psd", f""",
  b as (select image_id, "set", {BAND_CASE.format(d='')} as dist, f, log10(p) as q from psd),
  tot as (select dist, f, sum(q) s, count(q) n from b where "set" = 'real' and dist is not null group by dist, f),
  dd as (select b.dist, image_id, "set",
      sqrt(avg(power(q - case when "set" = 'real' then (s - q) / (n - 1) else s / n end, 2))) as d,
      avg(q - case when "set" = 'real' then (s - q) / (n - 1) else s / n end) as s
    from b join tot on tot.dist = b.dist and tot.f = b.f group by b.dist, image_id, "set")
  """ + GATE_SQL)
def sta04(spark, sf):
    c = _psd(spark, sf).selectExpr("image_id", "set", BAND_CASE.format(d="D") + " as dist", "f", "log10(p) as q")
    g = S.curve_gate(S.curve_distances(c.where("dist is not null"), "rms", at="f"))
    return g.selectExpr("dist", "n_real", *[f"round({c}, 6) as {c}" for c in ("rr_med", "rr_p95", "syn_mean", "ratio",
                                                                            "bias")], "passed")


@query("sta05_corpus_notes", "", """
  with shapes as (select case when c_mktsegment = 'BUILDING' then 'synthetic' else 'real' end as "set",
      c_custkey // 100 as group_id, 100 * (1 + c_nationkey) as height, 1 + c_nationkey + c_custkey % 7 as width
    from customer)
  select g.group_id, n_syn < 20 as few, n_syn, coalesce(n_size, 0) > 0 as size_differs, coalesce(n_size, 0) as n_sizes
  from (select group_id, count(*) filter ("set" = 'synthetic') as n_syn from shapes group by group_id) g
  left join (select group_id, count(*) as n_size from (
     select group_id, height, width from shapes where "set" = 'synthetic' except
     select group_id, height, width from shapes where "set" = 'real') group by group_id) d using (group_id)""")
def sta05(spark, sf):
    """Notes on a corpus: fewer than 20 synthetic images, sizes no real image has."""
    s = V.table(spark, sf, "customer").selectExpr(
        "case when c_mktsegment = 'BUILDING' then 'synthetic' else 'real' end as set", "c_custkey div 100 as group_id",
        "100 * (1 + c_nationkey) as height", "1 + c_nationkey + c_custkey % 7 as width")
    n = s.groupBy("group_id").agg(F.expr("count_if(set = 'synthetic')").alias("n_syn"))
    cols = ["group_id", "height", "width"]
    d = (s.where("set = 'synthetic'").select(*cols).subtract(s.where("set = 'real'").select(*cols))
         .groupBy("group_id").agg(F.count(F.lit(1)).alias("n_size")))
    return n.join(d, "group_id", "left").selectExpr(
        "group_id", "n_syn < 20 as few", "n_syn", "coalesce(n_size, 0) > 0 as size_differs",
        "coalesce(n_size, 0) as n_sizes")


@query("sta06_spearman", "profiles", """,
  r as (select image_id, rank() over (partition by image_id order by contrast)
      + (count(*) over (partition by image_id, contrast) - 1) / 2.0 as ra,
      rank() over (partition by image_id order by fwhm)
      + (count(*) over (partition by image_id, fwhm) - 1) / 2.0 as rb from profiles)
  select image_id, round(corr(ra, rb), 6) as rho, count(*) as n from r group by image_id""")
def sta06(spark, sf):
    return S.spearman(V.profiles(spark, sf), ["image_id"], "contrast", "fwhm").selectExpr(
        "image_id", "round(rho, 6) as rho", "n")


@query("sta07_loglog_slope", "psd", """
  select image_id, round(case when count(*) >= 2 then -regr_slope(ln(p), ln(f)) end, 6) as slope
  from psd where f >= 1 / 16.0 and f <= 0.25 and p > 0 group by image_id""")
def sta07(spark, sf):
    return (_psd(spark, sf).where("f >= 1 / 16.0D and f <= 0.25D and p > 0").groupBy("image_id")
            .agg(F.expr("round(case when count(1) >= 2 then -regr_slope(ln(p), ln(f)) end, 6)").alias("slope")))


CMP = ", ".join(f"round({s}_{c}, 6) as {s}_{c}" for s in ("real", "dense", "syn") for c in ("mean", "sd", "min", "max"))


def _side(name, cond):
    return ", ".join(f"{f}(value) filter ({cond}) as {name}_{c}" for f, c in
                     (("avg", "mean"), ("stddev_samp", "sd"), ("min", "min"), ("max", "max"))) + \
        f", count(value) filter ({cond}) as n_{name}"


oracle.define("sides", ("image_stats",), f"""
  select key, {_side("real", '''"set" = 'real' ''')}, {_side("dense", '''"set" = 'real' and site = 0''')},
    {_side("syn", '''"set" = 'synthetic' ''')} from image_stats group by key""")


@query("sta09_compare_sets", "sides", f"""
  select key, {CMP}, n_real, n_dense, n_syn,
    round(case when n_real >= 2 and n_syn > 0 and real_sd > 0 then (syn_mean - real_mean) / real_sd end, 6) as z_pooled,
    round(case when n_dense >= 2 and n_syn > 0 and dense_sd > 0 then (syn_mean - dense_mean) / dense_sd end, 6)
      as z_dense,
    coalesce(n_dense > 0 and n_syn > 0 and syn_mean between dense_min and dense_max, false) as in_dense
  from sides""")
def sta09(spark, sf):
    c = S.compare_sets(V.image_stats(spark, sf))
    return c.selectExpr("key", *CMP.split(", r")[0:1], *["r" + x for x in CMP.split(", r")[1:]], "n_real", "n_dense",
                        "n_syn", "round(z_pooled, 6) as z_pooled", "round(z_dense, 6) as z_dense", "in_dense")


@query("sta10_separates", "sides", """
  select key, case when n_dense < 2 or n_syn = 0 then 'n/a' when far and apart then 'yes'
      when far or apart then 'partly' else 'no' end as separates
  from (select *, case when dense_sd > 0 then abs(syn_mean - dense_mean) / dense_sd > 3 else syn_mean <> dense_mean end
      as far, (syn_max < dense_min or syn_min > dense_max) as apart from sides)""")
def sta10(spark, sf):
    return S.compare_sets(V.image_stats(spark, sf)).select("key", "separates")


@query("sta11_robust_sd", "profiles", """
  select image_id, round(1.4826 * median(abs(contrast - m)), 6) as rsd
  from (select image_id, contrast, median(contrast) over (partition by image_id) as m from profiles) group by image_id""")
def sta11(spark, sf):
    return median_abs_dev(V.profiles(spark, sf), ["image_id"], "contrast").selectExpr(
        "image_id", "round(1.4826D * mad, 6) as rsd")


@query("sta12_scorecard_by_corpus", "image_stats stat_keys", """
  select site, cast(tier as bigint) as tier, key, n_real, n_syn, round(z, 6) as z, inside,
    case when n_real < 3 then null when n_syn = 0 then false else inside and abs(z) <= 2 end as passed from (
  select site, key, tier, n_real, n_syn, case when n_real < 3 or n_syn = 0 then null
      when rs > 0 then (sm - rm) / rs when sm = rm then 0.0 else sign(sm - rm) * 'infinity'::double end as z,
    case when n_real < 3 then null when n_syn = 0 then false else sm between lo and hi end as inside
  from (select site, s.key, k.tier, count(value) filter ("set" = 'real') n_real,
      count(value) filter ("set" = 'synthetic') n_syn, avg(value) filter ("set" = 'real') rm,
      stddev_samp(value) filter ("set" = 'real') rs, avg(value) filter ("set" = 'synthetic') sm,
      min(value) filter ("set" = 'real') lo, max(value) filter ("set" = 'real') hi
    from image_stats s join stat_keys k on k.key = s.key group by site, s.key, k.tier))""")
def sta12(spark, sf):
    c = S.scorecard(V.image_stats(spark, sf), V.stat_keys(spark, sf), by=["site"])
    return c.selectExpr("site", "cast(tier as bigint) as tier", "key", "n_real", "n_syn", "round(z, 6) as z", "inside",
                        "passed")


@query("top04_worst_keys", "card_passed", """
  select cast(rank as bigint) as rank, key, cast(tier as bigint) as tier, round(z, 6) as z, passed from (
    select *, row_number() over (order by abs(z) desc nulls last, key) as rank from card_passed)
  where rank <= 12""")
def top04(spark, sf):
    w = _card(spark, sf).orderBy(F.expr("abs(z)").desc_nulls_last(), "key").limit(12)
    # at most 12 rows are left to number
    return w.selectExpr("cast(row_number() over (order by abs(z) desc nulls last, key) as bigint) as rank", "key",
                        "cast(tier as bigint) as tier", "round(z, 6) as z", "passed")


# Means in whole millionths of a thousandth, summed as integers: means of doubles depend on the order of the rows, and images that are
# equally far from the median (the two in its middle, copies) were told apart by that.
@query("top10_typical_image", "", """
  with st as (select l_suppkey as image_id, l_returnflag || l_linestatus as key,
      cast(sum(cast(round(l_extendedprice * (1 - l_discount) * 1000000) as bigint)) as hugeint) * 1000
        // count(l_extendedprice * (1 - l_discount)) as value
    from lineitem where l_suppkey % 5 <> 0 group by l_suppkey, l_returnflag, l_linestatus)
  select key, arg_min(image_id, {'d': abs(value - m), 'i': image_id}) as typical
  from (select image_id, key, cast(value as double) as value, median(cast(value as double)) over (partition by key) as m from st
    where value is not null) group by key""")
def top10(spark, sf):
    """The real image nearest to the median of its key, of equally near ones the smallest id."""
    gain = "l_extendedprice * (1 - l_discount)"
    s = (V.table(spark, sf, "lineitem").where("l_suppkey % 5 <> 0").groupBy("l_suppkey", "l_returnflag", "l_linestatus")
         .agg(F.expr(f"cast(sum(cast(round({gain} * 1000000) as bigint)) as decimal(28, 0)) * 1000 div count({gain})").alias("value"))
         .selectExpr("l_suppkey as image_id", "concat(l_returnflag, l_linestatus) as key", "cast(value as double) as value")
         .where("value is not null"))
    m = quantiles(s, ["key"], "value", {"m": 0.5})
    return s.join(m, "key").groupBy("key").agg(
        F.expr("min_by(image_id, struct(abs(value - m), image_id))").alias("typical"))


@query("set04_name_differences", "image_stats", """,
  names as (select distinct "set", key, site, cast(floor(value / 1000) as bigint) as name from image_stats)
  select set_from, key, site, name from (
    (select 'real' as set_from, key, site, name from names where "set" = 'real' except
     select 'real', key, site, name from names where "set" = 'synthetic')
    union all
    (select 'synthetic' as set_from, key, site, name from names where "set" = 'synthetic' except
     select 'synthetic', key, site, name from names where "set" = 'real'))""")
def set04(spark, sf):
    """Names present in one set but not in the other, both ways."""
    s = V.image_stats(spark, sf).selectExpr("set", "key", "site", "cast(floor(value / 1000) as bigint) as name")
    side = {k: s.where(f"set = '{k}'").drop("set") for k in ("real", "synthetic")}
    return (side["real"].subtract(side["synthetic"]).withColumn("set_from", F.lit("real"))
            .unionByName(side["synthetic"].subtract(side["real"]).withColumn("set_from", F.lit("synthetic"))))


@query("src14_reference_without", "image_stats", """
  select key, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, round(min(value), 6) as min,
    round(max(value), 6) as max, count(value) as n from image_stats
  where "set" = 'real' and image_id not in (select s_suppkey from supplier where s_acctbal < 0) group by key""")
def src14(spark, sf):
    """Reference store without excluded names; the summary is made again from what is left."""
    out = V.table(spark, sf, "supplier").where("s_acctbal < 0").selectExpr("s_suppkey as image_id")
    kept = V.image_stats(spark, sf).where("set = 'real'").join(out, "image_id", "left_anti")
    return S.summarise(kept).selectExpr("key", *[f"round({c}, 6) as {c}" for c in ("mean", "sd", "min", "max")], "n")


@query("src15_merge_documents", "", """
  with parts as (select o_custkey as key, o_orderdate as doc, o_orderkey as ord, o_totalprice as value from orders)
  select key, arg_max(value, {'d': doc, 'o': ord}) as value, count(*) as n_docs from parts group by key""")
def src15(spark, sf):
    """Partial documents united: the latest document wins per key."""
    d = V.table(spark, sf, "orders")
    return d.groupBy(F.col("o_custkey").alias("key")).agg(
        F.expr("max_by(o_totalprice, struct(o_orderdate, o_orderkey))").alias("value"),
        F.count(F.lit(1)).alias("n_docs"))
