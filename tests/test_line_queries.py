"""The queries over the line model take few jobs, as images that fit a task are settled there (rounds of joins: some five hundred before any of them began)."""
from __future__ import annotations

import pytest

from filigrane.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["itr15_totals", "itr15_observable_truth", "val04_graph_checks"])
def test_few_jobs(spark, name):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        rows = catalog.QUERIES[name](spark, SF).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert rows and 0 < len(sc.statusTracker().getJobIdsForGroup(name)) < 250
