"""Segments in cells, crowded cells, and crossings and overlaps at a node that both edges share."""
import math
import random

from filigrane.operators import relate as J

SAMPLE = ("image_id long, vid long, i long, x double, y double, z double, tx double, ty double, s_px double, r double")
ENDS = "vid long, node long, x double, y double, reach double"


def line(vid, p, q, n, z=1.0, r=1.0):
    d = math.dist(p, q)
    t = [(q[k] - p[k]) / d for k in (0, 1)]
    return [(1, vid, i, p[0] + (q[0] - p[0]) * i / n, p[1] + (q[1] - p[1]) * i / n, z, *t, d * i / n, r) for i in range(n + 1)]


def test_cells_of_segments(spark):
    rng = random.Random(1)
    ends = [tuple(rng.uniform(-60, 60) for _ in range(4)) for _ in range(60)] + [(0.0, 0.0, 16.0, 16.0), (3.0, 9.0, 3.0, -30.0),
            (5.0, 7.0, 40.0, 7.0), (8.0, 8.0, 8.0, 8.0), (9.0, 1.0, 9.0 + 1e-9, 50.0)]
    df = spark.createDataFrame([(k, *e) for k, e in enumerate(ends)], "k long, x double, y double, x_p1 double, y_p1 double")
    got = {}
    for r in J.in_cells(df, 8.0).collect():
        assert (r._cx, r._cy) not in got.setdefault(r.k, set())
        got[r.k].add((r._cx, r._cy))
    for k, (x, y, x1, y1) in enumerate(ends):
        on = {(math.floor((x + (x1 - x) * t / 4000) / 8), math.floor((y + (y1 - y) * t / 4000) / 8)) for t in range(4001)}
        assert on <= got[k] and len(got[k]) <= 2 * (abs(x1 - x) + abs(y1 - y)) / 8 + 6


def test_diagonal_has_rows_by_its_length(spark):
    df = spark.createDataFrame([(0.5, 0.5, 100_000.0, 99_000.0)], "x double, y double, x_p1 double, y_p1 double")
    assert J.in_cells(df, 8.0).count() < 30_000


def test_crowded_cells(spark):
    rng = random.Random(5)
    rows = [s for v in range(40) for s in line(v, (rng.uniform(0, 20), rng.uniform(0, 20)), (rng.uniform(0, 20), rng.uniform(0, 20)), 3)]
    s = spark.createDataFrame(rows, SAMPLE)
    a, b = (sorted(J.crossings(s, hot=h).select("a", "b", "i", "j").collect()) for h in (50_000, 7))
    assert a == b and len(a) > 100


def test_crossings_at_a_shared_node(spark):
    node = (0.0, 0.0)
    rows = line(1, node, (40.0, 4.0), 40) + line(2, (0.0, 1.0), (40.0, 0.0), 40) + line(3, (0.0, 2.5), (40.0, 1.5), 40, z=9.0)
    s = spark.createDataFrame(rows, SAMPLE)
    pairs = lambda **k: {(r.a, r.b) for r in J.crossings(s, **k).collect()}
    every = pairs()
    assert every == {(1, 2), (1, 3)}  # at x = 8 and x = 20
    ends = spark.createDataFrame([(v, 7, *node, 25.0) for v in (1, 2, 3)] + [(1, 8, 40.0, 4.0, 5.0), (2, 9, 40.0, 0.0, 5.0)], ENDS)
    assert pairs(ends=ends) == {(1, 3)}  # 1 and 2 touch in depth within the reach; 3 lies deeper
    assert pairs(ends=ends, near_node=5.0) == every and pairs(ends=ends, near_node=30.0) == set()
    other = spark.createDataFrame([(1, 7, *node, 25.0), (2, 6, *node, 25.0)], ENDS)
    assert pairs(ends=other) == every  # no node in common


def test_overlaps_at_a_shared_node(spark):
    rows = line(1, (0.0, 0.0), (40.0, 6.0), 40) + line(2, (0.0, 0.0), (40.0, -6.0), 40)
    s = spark.createDataFrame(rows, SAMPLE)
    ends = lambda reach: spark.createDataFrame([(1, 7, 0.0, 0.0, reach), (2, 7, 0.0, 0.0, reach)], ENDS)
    pairs = lambda **k: [(r.a, r.b, r.itself) for r in J.lumen_overlaps(s, 0.5, **k).collect()]
    assert pairs() == [(1, 2, False)] and pairs(ends=ends(4.0)) == [(1, 2, False)] and pairs(ends=ends(20.0)) == []


def test_no_samples(spark):
    s, e = spark.createDataFrame([], SAMPLE), spark.createDataFrame([], ENDS)
    assert J.crossings(s, e).count() == 0 and J.lumen_overlaps(s, 0.5, e).count() == 0
