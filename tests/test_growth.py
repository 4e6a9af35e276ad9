"""What a task holds and what is shuffled does not grow beyond the input."""
from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from filigrane.operators import network as N
from filigrane.operators import quantile, runs, scan, spline
from filigrane.operators.grid import near_positions
from filigrane.session import checkpointed


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_spread_by_their_number(spark):
    assert scan.spread(spark.range(100), 10).rdd.getNumPartitions() == 10
    assert scan.spread(spark.range(0), 10).count() == 0


def test_values_are_grouped_after_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(scan, "PART", 100)
    rows = [(k % 3, None if k % 7 == 0 else float(k % 50)) for k in range(1000)]
    d = spark.createDataFrame(rows, "g long, v double")
    got = scan.counted(d.where("v is not null"), 1000)
    assert got.rdd.getNumPartitions() == 10 and "partial_sum" in plan(got)
    assert {(r.g, r.v): r._w for r in got.collect()} == Counter(r for r in rows if r[1] is not None)


def test_curves_are_sampled_without_a_shuffle(spark):
    e = checkpointed(spark.createDataFrame([(v, [(float(v), 0.0), (1.0, 2.0), (3.0, v / 2), (4.0, 4.0)], [1.0, 2.0, 3.0]) for v in range(20)],
                                           "vid long, ctrl array<struct<x: double, y: double>>, r_ctrl array<double>"))
    c = spline.sample_curves(e, 8, profiles={"r": "r_ctrl"})
    assert "hashpartitioning" not in plan(c)
    rows = {(r.vid, r.ui): r for r in c.collect()}
    assert len(rows) == 180 and rows[5, 0].px is None and rows[5, 0].x == 5.0 and abs(rows[5, 8].y - 4) < 1e-12 and rows[5, 4].r == 2.0
    assert all(rows[v, u].px == rows[v, u - 1].x for v in range(20) for u in range(1, 9))


def test_few_positions_among_many(spark):
    few = spark.createDataFrame([(k % 2, float(k * 3), float(k % 5)) for k in range(30)], "image_id long, x double, y double")
    many = spark.createDataFrame([(k % 2, k * 0.37, (k * 7 % 90) / 9) for k in range(60)], "image_id long, x double, y double")
    a, b = near_positions(few, many, 2.0, dense=True), near_positions(few, many, 2.0)
    assert sorted(a.collect()) == sorted(b.collect()) and 0 < a.where("hit").count() < 30


def test_edges_are_made_once_for_all_rules(spark):
    nodes = spark.createDataFrame([(k, 10.0 * k, 10.0, 1.0) for k in range(4)], "nid long, x double, y double, depth double")
    edges = spark.range(3).selectExpr("id as vid", "id as u", "id + 1 as v", "'venule' as cls", "array(named_struct('x', 10D * id, 'y', 10D), "
                                      "named_struct('x', 10D * id + 10, 'y', 10D)) as ctrl", "array(1D, 1D) as r_ctrl", "array(1D, 1D) as z_ctrl")
    bad = N.problems(nodes, edges)
    assert "Range (" not in plan(bad)
    assert sorted((r.problem, r.id) for r in bad.collect()) == [("one in and one out", 1), ("one in and one out", 2)]


def test_quantiles_sort_in_parts_that_follow_the_rows(spark, monkeypatch):
    """Many parts in one group, a value with very many rows, and groups within a part: exact, and no part holds much more than its share."""
    monkeypatch.setattr(scan, "PART", 200)
    rng = np.random.default_rng(5)
    vals = [(0, float(v)) for v in rng.permutation(5000)] + [(1, 3.0)] * 3000 + [(k, float(k * j)) for k in range(2, 40) for j in range(9)]
    df = checkpointed(spark.createDataFrame(vals, "k long, v double").repartition(3))
    rows, n = quantile.ordered(df, ["k"], "v")
    assert n > 20 and rows.agg({"_w": "sum"}).first()[0] == len(vals)
    assert max(r["count"] for r in rows.groupBy("_part").count().collect()) < 1000
    got = {r.k: r for r in quantile.quantiles(df, ["k"], "v", {"a": 0.1, "m": 0.5, "z": 1.0}, count="n").collect()}
    lev = {(r.k, r.level): r.q for r in quantile.quantile_levels(df, ["k"], "v", [0.0, 0.37, 0.995], min_n=10).collect()}
    for k in range(40):
        x = np.array([v for g, v in vals if g == k])
        assert got[k].n == len(x) and np.allclose([got[k].a, got[k].m, got[k].z], np.quantile(x, [0.1, 0.5, 1.0]))
        assert k > 1 or np.allclose([lev[k, j] for j in range(3)], np.quantile(x, [0.0, 0.37, 0.995]))
    assert {k for k, _ in lev} == {0, 1}


def test_claims_are_swept_once(spark):
    """What is read several times after the sweep is a stored table."""
    c = checkpointed(spark.range(300).selectExpr("id % 3 as vid", "id as cid", "(id * 37) % 500 as lo", "(id * 37) % 500 + id % 40 as hi"))
    r = runs.share_runs(c, ["vid"], ["cid"], "(lo + hi) div 2", ["lo", "cid"], "owner.cid % 5")
    assert "MapInPandas" not in plan(r)
    want = runs.owner_runs(runs.share_out(c, ["vid"], ["cid"], "(lo + hi) div 2", ["lo", "cid"]).withColumn("owner", F.expr("owner.cid % 5")), ["vid"])
    assert sorted(r.collect()) == sorted(want.collect()) and r.count() > 30
