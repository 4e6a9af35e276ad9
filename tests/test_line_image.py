"""Images solved in one task each: the same tables as by rounds of joins, and few jobs however many rounds an image needs."""
from __future__ import annotations

import random

import pytest

from filigrane.operators import lines as L
from tests.test_lines import chain_of_claims, frames, gap_in_a_claim, image, invisible_crosser, kiss

KINDS = ("samples", "runs", "edges", "degree")


def tables(found):
    st, active = found
    return {k: sorted(map(repr, df.select(sorted(df.columns)).collect())) for k, df in [*((k, getattr(st, k)) for k in KINDS), ("active", active)]}


@pytest.fixture(scope="module")
def given(spark):
    rng = random.Random(5)
    return frames(spark, [*(image(rng, k, 4, n) for k, n in enumerate((60, 30, 40))), *(case() for case in (chain_of_claims, gap_in_a_claim, invisible_crosser, kiss))])


def test_in_a_task_equals_rounds(given):
    """All images in memory, and the larger ones in rounds: the same samples, runs, edges, degrees and junctions."""
    sizes = given[0].groupBy("image_id").count().collect()
    assert min(r["count"] for r in sizes) <= 130 < max(r["count"] for r in sizes)
    whole = tables(L.line_fixpoint(*given))
    assert all(whole.values())
    assert tables(L.line_fixpoint(*given, small=130)) == whole


def test_few_jobs(spark, given):
    """The jobs of images that fit a task do not grow with their rounds (rounds of joins took hundreds)."""
    sc = spark.sparkContext
    sc.setJobGroup("line-image", "jobs of a fixpoint")
    try:
        L.line_fixpoint(*given)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(sc.statusTracker().getJobIdsForGroup("line-image")) < 60


def test_images_that_are_not_whole_go_through_rounds(spark):
    """An edge that does not begin at 0, one with a null and one with a NaN are left to the joins."""
    s = [(m, 0, k + (m == 1), float(k), float("nan") if m == 3 and k == 4 else 0.0, 1.0, 1.0, 1.0, 1.0, True, None if m == 2 and k == 5 else True)
         for m in range(4) for k in range(20)]
    samples, records = (df for df in frames(spark, [(s, [], [], [])])[:2])
    assert [r.image_id for r in L._fitting(samples, records, L.SMALL).collect()] == [0]
