"""Chunked scans, quantiles, grid joins and matching against brute force on small data, with chunks small enough to
cross many borders."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigrane.operators import grid, network, quantile, relate, rules, runs, scan


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(3)
    rows = [(v, i, rnd.random() < 0.4, rnd.randint(0, 9)) for v in (1, 2, 3) for i in range(60 + 20 * v)]
    return rows, spark.createDataFrame(rows, "vid LONG, i LONG, ok BOOLEAN, w LONG")


def test_running_values_cross_chunks(series):
    rows, df = series
    d = scan.running(df.withColumn("c", F.expr("i div 7")), ["vid"], ["i"], "c",
                     {"s": ("sum", "w"), "p": ("max", "case when ok then i end"),
                      "n": ("min", "case when ok then i end", "back"), "l": ("last", "case when ok then w end")},
                     exclusive=("p",))
    for r in d.collect():
        own = [x for x in rows if x[0] == r.vid]
        before = [x for x in own if x[1] <= r.i]
        assert r.s == sum(x[3] for x in before)
        hits = [x[1] for x in own if x[1] < r.i and x[2]]
        assert r.p == (max(hits) if hits else None)
        after = [x[1] for x in own if x[1] >= r.i and x[2]]
        assert r.n == (min(after) if after else None)
        last = [x[3] for x in before if x[2]]
        assert r.l == (last[-1] if last else None)


@pytest.mark.parametrize("chunk", [7, 4096])
def test_bridge_and_islands(series, chunk):
    rows, df = series
    got = {(r.vid, r.i): r.b for r in runs.bridge(df, "ok", 3, keys=("vid",), out="b", chunk=chunk).collect()}
    for v in (1, 2, 3):
        ok = [x[2] for x in rows if x[0] == v]
        want = list(ok)
        idx = [k for k, o in enumerate(ok) if o]
        for a, b in zip(idx, idx[1:]):
            if b - a <= 3:
                want[a:b] = [True] * (b - a)
        assert [got[v, k] for k in range(len(ok))] == want
    isl = {(r.vid, r.run_start): r.run_end for r in scan.islands(df, ["vid"], "ok", chunk=chunk).collect()}
    for v in (1, 2, 3):
        ok = [x[2] for x in rows if x[0] == v] + [False]
        start = None
        for k, o in enumerate(ok):
            if o and start is None:
                start = k
            if not o and start is not None:
                assert isl.pop((v, start)) == k - 1
                start = None
    assert not isl


def test_halo_frames(series):
    rows, df = series
    from pyspark.sql import Window
    d = scan.halo(df, 3, chunk=7)
    w = Window.partitionBy("vid", "_c").orderBy("i").rowsBetween(-3, 3)
    got = scan.own(d.withColumn("s", F.sum("w").over(w))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.s == sum(x[3] for x in rows if x[0] == r.vid and abs(x[1] - r.i) <= 3)


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = [(k, float(v)) for k, n in ((0, 1), (1, 7), (2, 5000)) for v in rng.lognormal(0, 3, n).round(2)]
    df = spark.createDataFrame(vals, "k LONG, v DOUBLE")
    q = {r.k: r for r in quantile.quantiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.95}).collect()}
    lev = quantile.quantile_levels(df, ["k"], "v", quantile.Q_LEVELS, min_n=20).collect()
    for k in (0, 1, 2):
        x = np.array([v for kk, v in vals if kk == k])
        for n, p in (("a", 0.05), ("b", 0.5), ("c", 0.95)):
            assert math.isclose(q[k][n], np.quantile(x, p), rel_tol=1e-9)
    x = np.array([v for kk, v in vals if kk == 2])
    assert {r.k for r in lev} == {2} and len(lev) == 100
    for r in lev:
        assert math.isclose(r.q, np.quantile(x, quantile.Q_LEVELS[r.level]), rel_tol=1e-9)


@pytest.mark.parametrize("hot", [5, 50_000])
def test_close_pairs_equal_the_cross_join(spark, hot, monkeypatch):
    """400 random points, a tenth of them wide, a crowd in one spot that has to be split."""
    monkeypatch.setattr(grid.grid_join, "__defaults__", (("image_id",), hot, "inner", "a_x", "a_y", "b_x", "b_y"))
    rnd = random.Random(5)
    pts = [(0, k, rnd.uniform(0, 100), rnd.uniform(0, 100), rnd.uniform(2, 6) if k % 10 == 0 else rnd.uniform(0.2, 2))
           for k in range(300)] + [(0, 300 + k, 50 + rnd.random(), 50 + rnd.random(), 0.3) for k in range(100)]
    df = spark.createDataFrame(pts, "image_id LONG, id LONG, x DOUBLE, y DOUBLE, r DOUBLE")
    got = sorted((r.a_id, r.b_id) for r in relate.close_pairs(df, "id", 0.5).collect())
    want = sorted((a[1], b[1]) for a in pts for b in pts if a[1] < b[1]
                  and math.hypot(a[2] - b[2], a[3] - b[3]) < a[4] + b[4] + 0.5)
    assert got == want


def test_match_in_order_equals_the_greedy_loop(spark):
    rnd = random.Random(7)
    cand = [(0, t, j, rnd.random(), t) for t in range(60) for j in range(60) if rnd.random() < 0.15]
    df = spark.createDataFrame(cand, "image_id LONG, t LONG, j LONG, d DOUBLE, ord LONG")
    got = {r.t: r.j for r in relate.match_in_order(df, "t", "j", "d", "ord").collect()}
    used, want = set(), {}
    for t in range(60):
        free = [(c[3], c[2]) for c in cand if c[1] == t and c[2] not in used]
        if free:
            want[t] = min(free)[1]
            used.add(want[t])
    assert got == want


def test_linkage_equals_the_sequential_one(spark):
    rnd = random.Random(11)
    pts = {k: (rnd.uniform(0, 60), rnd.uniform(0, 60), rnd.uniform(3, 9)) for k in range(70)}
    dist = {(a, b): math.hypot(pts[a][0] - pts[b][0], pts[a][1] - pts[b][1]) for a in pts for b in pts if a < b}
    fits = [(0, a, b) for (a, b), d in dist.items() if d <= pts[a][2] + pts[b][2]]
    pairs = [(0, a, b, d) for (a, b), d in dist.items() if d <= 0.8 * (pts[a][2] + pts[b][2])]
    root = {k: k for k in pts}
    fset = {(a, b) for _, a, b in fits}
    for _, a, b, d in sorted(pairs, key=lambda p: (p[3], p[1], p[2])):
        ra, rb = root[a], root[b]
        if ra == rb:
            continue
        A, B = [k for k in pts if root[k] == ra], [k for k in pts if root[k] == rb]
        if all((min(x, y), max(x, y)) in fset for x in A for y in B):
            for x in A + B:
                root[x] = min(ra, rb)
    got = rules.linkage(spark.createDataFrame([(0, k) for k in pts], "image_id LONG, id LONG"),
                        spark.createDataFrame(pairs, "image_id LONG, a LONG, b LONG, d DOUBLE"),
                        spark.createDataFrame(fits, "image_id LONG, a LONG, b LONG"))
    assert {r.id: r.cluster for r in got.collect()} == root


def test_components_and_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6), (9, 5)], "src LONG, dst LONG")
    n = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 6, 9)], "node LONG")
    got = {r.node: r.comp for r in network.connected_components(e, n).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 9: 5}
    nodes = spark.createDataFrame([(k,) for k in range(6)], "nid LONG")
    edges = spark.createDataFrame([(0, 1), (1, 2), (3, 4), (4, 5), (5, 3)], "u LONG, v LONG")
    lev, left = network.levels(nodes, edges)
    assert {r.nid: r.level for r in lev.collect()} == {0: 0, 1: 1, 2: 2}
    assert {r.nid for r in left.collect()} == {3, 4, 5}
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (8, 7)], "id LONG, target LONG")
    assert {r.id: r.target for r in network.follow(links).collect()} == {1: 4, 2: 4, 3: 4}


def test_owner_example(spark):
    """Claims on one line: gaps inside a claim are closed, A-B-A gives A's farther piece to B."""
    rows = [(0, 5, 10, 1), (0, 12, 20, 1), (0, 30, 34, 2), (0, 35, 37, 3), (0, 38, 45, 2), (0, 52, 58, 4), (0, 70, 75, 4)]
    cen = {1: 12, 2: 32, 3: 36, 4: 65}
    r = spark.createDataFrame(rows, "vid LONG, lo LONG, hi LONG, owner LONG")
    r = runs.join_owner_gaps(r, ["vid"], "5.95D")
    case = "element_at(map(" + ", ".join(f"{k}L, {v}L" for k, v in cen.items()) + "), owner)"
    r = runs.give_back(r, ["vid"], f"least(abs(lo - {case}), abs(hi - {case}))")
    got = sorted((x.lo, x.hi, x.owner) for x in r.collect())
    assert got == [(5, 20, 1), (30, 34, 2), (35, 45, 3), (52, 58, 4), (70, 75, 4)]
