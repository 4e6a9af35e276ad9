"""Grid joins: crowded cells in parts give the same pairs, and what is copied into cells is shuffled once."""
from __future__ import annotations

import random

from filigrane.operators import grid as G
from filigrane.session import checkpointed


def points(spark):
    rng = random.Random(8)
    rows = [(m, k, rng.gauss(0, 4), rng.gauss(0, 4)) for m in range(2) for k in range(150)] + [(0, 150, None, 1.0)]
    return checkpointed(spark.createDataFrame(rows, "image_id long, k long, x double, y double"))


def joined(p, how="inner", hot=50_000):
    on = "sqrt((a_x - b_x) * (a_x - b_x) + (a_y - b_y) * (a_y - b_y)) < 1.5"
    return G.grid_join(G.tag(p, "a"), G.tag(p, "b"), 1.5, on, hot=hot, how=how)


def test_crowded_cells_give_the_same_pairs(spark):
    p = points(spark)
    rows = p.where("x is not null").collect()
    want = sorted((a.image_id, a.k, b.k) for a in rows for b in rows
                  if a.image_id == b.image_id and ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) ** 0.5 < 1.5)
    for hot in (50_000, 40, 3):
        assert sorted((r.image_id, r.a_k, r.b_k) for r in joined(p, hot=hot).collect()) == want


def test_copies_are_shuffled_once(spark):
    """A left join of the copies with the crowded cells by shuffle would move and sort all of them twice."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joined(points(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert plan.count("SortMergeJoin") == 1 and "_part" in plan
