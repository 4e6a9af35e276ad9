"""Nothing is lost beyond sizes that used to be limits, and every rule of the network check fires."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from filigrane.operators import network as N
from filigrane.operators import raster as A
from filigrane.operators import relate as J
from filigrane.operators.scoring import junction_score
from filigrane.operators.spline import sample_profile
from filigrane.plans.pixels import fill_invalid


def test_long_chain_is_one_component(spark):
    n = 300
    pairs = spark.createDataFrame([((k * 7) % n, ((k + 1) * 7) % n) for k in range(n - 1)], "src long, dst long")
    assert {r.comp for r in N.connected_components(pairs).collect()} == {0}


def test_nearest_at_any_distance(spark):
    left = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 9000.0, 0.0), (2, 3, 0.0, 0.0)], "image_id long, id long, x double, y double")
    right = spark.createDataFrame([(1, 7, 40.0, 30.0)], "image_id long, tag long, x double, y double")
    got = {r.id: (round(r.distance, 3), r.nearest) for r in J.nearest_any(left, right, "id", "b_tag", 1.0).collect()}
    assert got == {1: (50.0, 7), 2: (round(math.hypot(8960, 30), 3), 7)}


def test_long_segments_cross(spark):
    rows = [(1, 1, 0, -200.0, 0.0), (1, 1, 1, 200.0, 4.0), (1, 2, 0, 3.0, -150.0), (1, 2, 1, 3.0, 150.0)]
    s = spark.createDataFrame([(*r, 1.0, 1.0, 0.0, float(r[2] * 400), 1.0) for r in rows],
                              "image_id long, vid long, i long, x double, y double, z double, tx double, ty double, s_px double, r double")
    got = J.crossings(s).collect()
    assert len(got) == 1 and abs(got[0].x - 3) < 1e-9 and abs(got[0].y - 2.03) < 1e-9


def test_wide_junctions_match(spark):
    traced = spark.createDataFrame([(1, 5, 0.0, 90.0, "a")], "image_id long, tj long, x double, y double, type string")
    truth = spark.createDataFrame([(1, 8, 0.0, 0.0, 100.0)], "image_id long, jid long, x double, y double, radius double")
    assert [(r.a_tj, r.b_jid) for r in J.within_radius(traced, truth, 3.0).collect()] == [(5, 8)]
    assert junction_score.__code__.co_argcount == 4


def test_curves_of_every_size(spark):
    df = spark.createDataFrame([(n, [2.5] * n) for n in range(1, 60)], "vid long, v array<double>")
    got = sample_profile(df, "v", 3, "out").collect()
    assert len(got) == 59 * 4 and all(abs(r.out - 2.5) < 1e-9 for r in got)


def test_stencil_wider_than_many_images(spark):
    px = spark.createDataFrame([(1, 0, x, float(x)) for x in range(2)], "image_id long, y long, x long, value double")
    got = A.convolve(px, {"out": ("value", [(o, 1.0) for o in range(-15, 16)])}, "x", "2")
    # mirrored: 0 1 | 1 0 0 1 1 0 ...; 31 taps around each pixel
    line = [abs((p % 4) - 1.5) < 1 for p in range(-40, 40)]
    want = [sum(line[40 + x + o] for o in range(-15, 16)) for x in range(2)]
    assert [r.out for r in got.orderBy("x").collect()] == [float(w) for w in want]


def test_unreached_pixels_stay(spark):
    px = spark.createDataFrame([(1, 0, 0, None), (1, 0, 1, None), (2, 0, 0, 3.0), (2, 0, 1, None)],
                               "image_id long, y long, x long, value double")
    got = {(r.image_id, r.x): (r.value, r.filled) for r in fill_invalid(px, 1.0, "2", "1", 2).collect()}
    assert got[1, 0] == (None, True) and got[1, 1] == (None, True) and got[2, 0] == (3.0, False) and abs(got[2, 1][0] - 3) < 1e-9


def test_every_network_rule_fires(spark):
    nodes = spark.createDataFrame([(k, float(10 * k), 50.0, 0.0, None) for k in range(8)] + [(9, 50.0, 70.0, 0.0, None)],
                                  "nid long, x double, y double, depth double, pressure double")

    def edge(vid, u, v, x0, x1, z=0.0, r=1.0, cls="capillary"):
        return (vid, u, v, [(x0, 50.0), (x1, 50.0)], [z, z], [r, r], cls)
    edges = spark.createDataFrame([
        edge(1, 0, 1, 0.0, 10.0), edge(2, 1, 99, 10.0, 20.0), edge(3, 1, 3, 10.0, 33.0), edge(4, 3, 4, 30.0, 40.0, z=0.5),
        edge(5, 3, 5, 30.0, 50.0, r=0.0), edge(6, 4, 6, 40.0, 60.0, z=-0.01), edge(7, 4, 7, 40.0, 70.0, cls="road")],
        "vid long, u long, v long, ctrl array<struct<x: double, y: double>>, z_ctrl array<double>, r_ctrl array<double>, cls string")
    got = {(r.problem, r.id) for r in N.problems(nodes, edges, (0, 0, 200, 100)).collect()}
    for found in (("node missing", 2), ("end not on node", 3), ("depth at end differs", 4), ("radius not positive", 5),
                  ("negative depth", 6), ("unknown class", 7), ("isolated", 9), ("free end inside the domain", 7)):
        assert found in got, found
    assert {k for p, k in got if p == "unknown class"} == {7} and {k for p, k in got if p == "isolated"} == {2, 9}


def test_scalar_functions(spark):
    from filigrane.functions import columns as C
    one = spark.range(1)
    cases = {C.angle_deg("1.0D", "-1.0D"): 135.0, C.angle_between_deg("1.0D", "0.0D", "0.0D", "-1.0D"): 90.0,
             C.acute_angle_deg("1.0D", "0.0D", "-1.0D", "0.0D"): 0.0, C.line_offset("0.0D", "0.0D", "1.0D", "0.0D", "7.0D", "-3.0D"): 3.0,
             C.smoothstep("5.0D", "0.0D", "10.0D"): 0.5, C.log_floor("0.0D"): math.log(1e-6), C.significant("0.0123456D", 3): 0.0123,
             C.significant("98765.0D", 2): 99000.0, C.clip("5.0D", "0.0D", "2.0D"): 2.0}
    got = one.select(*[F.expr(C.doubles(e)).alias(f"c{k}") for k, e in enumerate(cases)]).first()
    assert all(abs(g - w) < 1e-9 for g, w in zip(got, cases.values())), list(zip(got, cases.values()))


def test_outliers_leave_bins_small(spark):
    """One far value and one heavy group: exact quantiles and ranks, and no bin with more than a few values."""
    import numpy as np

    from filigrane.operators.quantile import quantiles, value_bins
    from filigrane.operators.scorecard import average_ranks, spearman
    rng = np.random.default_rng(3)
    a = np.concatenate([rng.random(3000), [1e12]])
    b = np.round(a % 1 + rng.random(3001) * 0.5, 2)
    df = spark.createDataFrame([("g", float(x), float(y)) for x, y in zip(a, b)], "g string, a double, b double")
    q = quantiles(df, ["g"], "a", {"q1": 0.25, "q9": 0.9}).first()
    assert np.allclose([q.q1, q.q9], np.quantile(a, [0.25, 0.9]))
    bins = value_bins(df.selectExpr("g", "a", "1L as w"), ["g"], "a", "w").groupBy("_b").count()
    assert bins.agg(F.max("count")).first()[0] < 40
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    got = {r.b: r.k for r in average_ranks(df, ["g"], "b", "k").collect()}
    assert got == dict(zip(b.tolist(), rank(b).tolist()))
    rho = spearman(df, ["g"], "a", "b").first()
    assert abs(rho.rho - np.corrcoef(rank(a), rank(b))[0, 1]) < 1e-9 and rho.n == 3001
