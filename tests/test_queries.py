"""A cross-section of the registered queries against their SQL at the smallest useful scale."""
import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.01"
NAMES = ("sta01_scorecard", "sta09_compare_sets", "run03_observable_mask", "run10_claims", "jn03_crossings", "jn10_inside_taken",
         "agg11_centreline_score", "itr04_strahler_order", "skl05_enclosed_loops", "ker02_band_rms", "rul06_observable_type",
         "src01_read_network")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    ok, msg, *_ = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, msg


def test_every_statement_binds(con):
    """All SQL is valid on the given tables."""
    for name, sql in entry.oracle_sql().items():
        con.execute(f"explain {sql}")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
