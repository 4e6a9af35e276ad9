"""Rows without an id and rows that repeat one are rows of their own in every operator."""
from __future__ import annotations

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from filigrane.llm import catalog, copies, decontaminate, forest, mixing, pii, shards
from tests.llm.test_operators import table


def text(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    """Ids 3, 5, 5, null, null with texts a, b, a, c, c; and 200 rows without an id."""
    rng = random.Random(9)
    a, b, c = (text(rng, 40) for _ in range(3))
    return [(3, a), (5, b), (5, a), (None, c), (None, c)] + [(None, text(rng, 100)) for _ in range(200)]


def left(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_one_row_of_each_group(spark, docs):
    want = Counter(set(docs) - {(5, docs[0][1])})
    df = table(spark, docs)
    assert left(copies.exact_dedup(df)) == want
    assert left(forest.distinct_documents(df)) == want
    assert copies.exact_dedup(df).columns == df.columns == forest.distinct_documents(df).columns


def test_near_copies_without_ids(spark):
    rng = random.Random(2)
    one = text(rng, 200)
    near = one.rsplit(" ", 1)[0] + " other"
    rows = [(None, one), (None, near), (None, one), (7, near), (None, ""), (None, None), (None, "")]
    got = left(forest.distinct_documents(table(spark, rows)))
    assert sum(n for (_, t), n in got.items() if t) == 1 and sum(got.values()) == 4


def test_only_the_contaminated_row_goes(spark, docs):
    items = [(1, f"{docs[10][1]} {docs[11][1]}")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(None, items[0][1]), (None, docs[20][1]), (None, docs[21][1]), (4, items[0][1]), (4, docs[22][1]), (5, docs[23][1])]
    df = table(spark, rows)
    assert left(decontaminate.clean(df, bench)) == Counter([rows[k] for k in (1, 2, 4, 5)])
    got = Counter((r.doc_id, r.contaminated) for r in decontaminate.judge(df, bench).collect())
    assert got == Counter({(None, True): 1, (None, False): 2, (4, True): 1, (4, False): 1, (5, False): 1})


def test_budget_holds(spark, docs):
    one = [("all", F.lit("x"))]
    for rows, budget in ((docs[5:], 5000), ([(k % 3, t) for k, (_, t) in enumerate(docs[5:])], 5000), ([(None, docs[5][1])] * 50, 1234)):
        got = mixing.mix(table(spark, rows), one, [F.lit(1)], budget).select("_mix.*").collect()
        assert budget - 50 < sum(r["take"] for r in got) <= budget
    got = mixing.mix(table(spark, docs[5:]), one, [F.lit(1)], 5000).select("_mix.*").collect()
    assert sum(r["take"] < r["tokens"] for r in got) <= 1


def test_shards_stay_even(spark, docs):
    df = catalog.sharding(table(spark, docs[5:] * 3 + [(k, docs[5 + k][1]) for k in range(100)])).groupBy("shard").agg(
        F.sum("size").alias("bytes"), F.max("size").alias("most")).collect()
    mean = sum(r["bytes"] for r in df) / shards_wanted()
    assert len(df) == shards_wanted() and all(abs(r["bytes"] - mean) < 0.5 * mean for r in df)


def shards_wanted():
    return catalog.SHARDS


def test_leaves_of_target_bytes(spark, docs):
    rows = [(k, docs[5 + k % 200][1]) for k in range(400)]
    got = shards.shard(table(spark, rows), [("id", shards.hashed(F.col("doc_id")))], target_bytes=20_000).groupBy("shard").agg(
        F.sum("size").alias("bytes")).collect()
    total = sum(r["bytes"] for r in got)
    assert len(got) == -(-total // 20_000) and all(r["bytes"] <= 20_000 + 2000 for r in got)


def test_emails_are_found_in_one_pass():
    body = "@name and a@b " * 700_000 + "x.y@example.org"
    t = time.time()
    assert [body[a:b] for a, b in pii._emails(body)] == ["x.y@example.org"]
    assert [m for m in pii._emails("a@b.c@d.e f@@g.h i@j.k")] == [(0, 5), (17, 22)]
    assert time.time() - t < 4
