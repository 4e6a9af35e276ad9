"""Events of images that fit a task are clustered there: the same clusters as by rounds of joins, and few jobs."""
from __future__ import annotations

import random

import numpy as np
import pytest

from filigrane.operators import event_image as M
from filigrane.operators import events as V


@pytest.fixture(scope="module")
def given(spark):
    """Two images of wandering lines with events along them, and one with two events."""
    rng, samples, cores = random.Random(3), [], []
    for m, lines, n in ((0, 5, 40), (1, 3, 25), (2, 1, 2)):
        for v in range(lines):
            x, y = rng.uniform(0, 60), rng.uniform(0, 60)
            for i in range(60):
                x, y = x + rng.choice((0, 1, 2)), y + rng.choice((-1, 0, 1))
                samples.append((m, v, i, float(x), float(y), 1.0 + v % 2, 1.0))
        for k in range(n):
            v, i = rng.randrange(lines), rng.randrange(60)
            x, y = next(s[3:5] for s in samples if s[:3] == (m, v, i))
            cores.append((f"c:{k}", m, "core", round(x), y, v, max(i - 4, 0), min(i + 4, 59), i))
    return (spark.createDataFrame([(*c[:3], float(c[3]), *c[4:]) for c in cores],
                                  "ev string, image_id long, kind string, x double, y double, vid long, lo long, hi long, anchor long"),
            spark.createDataFrame(samples, "image_id long, vid long, i long, x double, y double, r double, st double"))


def test_in_a_task_equals_joins_and_takes_few_jobs(spark, given):
    sc = spark.sparkContext

    def found(name, **limits):
        sc.setJobGroup(name, name)
        try:
            rows = V.cluster_events(*given, **limits).collect()
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        return sorted((r.image_id, r.ev, r.cluster, r.x, r.y, r.extent) for r in rows), len(sc.statusTracker().getJobIdsForGroup(name))
    whole, jobs = found("events-in-tasks")
    assert 0 < jobs < 40  # by rounds of joins well over a hundred
    assert 1 < len({r[:1] + r[2:3] for r in whole}) < len(whole)
    assert found("events-by-joins", discs=0)[0] == whole
    assert found("events-split", events=20)[0] == whole  # two of three images by joins


def test_linkage_one_pair_after_the_other():
    """Joined from the nearest pair on, where all members fit; ties by the smaller items."""
    fits = np.ones((5, 5), bool)
    fits[0, 2] = fits[2, 0] = False
    pairs = np.array([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 2.0), (3, 4, 2.0)])
    got = M.complete_linkage(fits, pairs[:, 0].astype(int), pairs[:, 1].astype(int), pairs[:, 2])
    assert got.tolist() == [0, 0, 2, 2, 2]


def test_discs_meet_in_small_steps(monkeypatch):
    rng = np.random.default_rng(4)
    n = np.array([5, 1, 7, 3])
    x, y, w = rng.uniform(0, 8, 16), rng.uniform(0, 8, 16), np.full(16, 0.6)
    first = np.cumsum(n) - n
    want = [b for b in (1, 2, 3) if any(np.hypot(x[i] - x[j], y[i] - y[j]) < 1.2 for i in range(5) for j in range(first[b], first[b] + n[b]))]
    for step in (1, 3, 1 << 20):
        monkeypatch.setattr(M, "STEP", step)
        assert M.meeting(x, y, w, first, n, 0, np.array([1, 2, 3])).tolist() == want
