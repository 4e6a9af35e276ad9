"""Ranked search against brute force."""
from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from filigrane.llm import search
from filigrane.llm.treap import Best, Treap
from tests.llm.test_operators import odd_rows, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(items, docs, k):
    held = [(i, Counter(cut(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10 ** 9 * c[w]) // (1000 * c[w] + 8 * m))
                    for w in set(cut(text)) if w in c)
            if s > 0:
                scores.append((-s, -2 ** 63 if i is None else i, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(60)] + ["Ünï", "X1", "ω", "a"]
    text = lambda m: " ".join(rng.choices(vocabulary, weights=[1 / (1 + k) for k in range(64)], k=m)).replace("w1 ", "W1.")
    docs = [(k, text(rng.choice([0, 1, 5, 40, 300]))) for k in range(n)]
    items = [(k, text(rng.choice([1, 3, 20]))) for k in range(12)]
    return items, docs + docs[:5] + [(None, docs[3][1]), (None, None)]


def items_table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "item_id long, text string, score int, _item int")


@pytest.mark.parametrize("n, seed, k", [(40, 1, 10), (300, 2, 10), (300, 3, 1), (90, 4, 1000)])
def test_ranks(spark, monkeypatch, n, seed, k):
    items, docs = corpus(n, seed)
    items += [items[0], (77, None), (78, ""), (79, "unknown words"), (None, "w3 w4")]
    got = search.rank_documents(items_table(spark, items), table(spark, docs), k)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(items, docs, k)


def test_small_blocks_and_slices(spark, monkeypatch):
    """Blocks of a few postings and slices of a few items change nothing."""
    items, docs = corpus(120, 5)
    monkeypatch.setattr(search, "BLOCK_POSTINGS", 50)
    got = search.rank_documents(items_table(spark, items), table(spark, docs), 5, slice_bytes=200)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(items, docs, 5)


def test_odd_rows(spark):
    docs = [(r[0], r[1]) for r in odd_rows()]
    items = [(1, "this LINE stands É a"), (2, docs[3][1][:4000]), (3, "$$")]
    got = search.rank_documents(items_table(spark, items), table(spark, docs), 10)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(items, docs, 10)


def test_copies_tie(spark):
    """A thousand copies have one score: the smallest ids come first."""
    docs = [(k, "the same words") for k in range(1000, 0, -1)] + [(0, "other words")]
    got = search.rank_documents(items_table(spark, [(1, "same")]), table(spark, docs), 10).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(1, 11)) and [r.rank for r in got] == list(range(1, 11))


def test_empty_tables(spark):
    items, docs = corpus(10, 6)
    assert search.rank_documents(items_table(spark, []), table(spark, docs)).count() == 0
    assert search.rank_documents(items_table(spark, items), table(spark, [])).count() == 0


def test_descent_gives_up_ranges():
    """Few documents hold all the item's words: most ranges are never opened to the end."""
    rng = np.random.default_rng(0)
    n = 4096
    doc = np.repeat(np.arange(n), 3)
    row = np.concatenate([rng.choice(500, 3, replace=False) for _ in range(n)])
    keep = np.unique(np.stack([row, doc]), axis=1)
    row, doc = keep
    impact = rng.integers(1, 1000, len(row))
    tree = Treap(row, doc, impact, np.arange(n))
    opened = []
    halves = tree._halves
    tree._halves = lambda s, *a: opened.append(len(s)) or halves(s, *a)
    best = Best(10)
    rows, weight = np.array([3, 4, 400]), np.array([5, 1, 9])
    tree.search(rows, weight, best)
    total = np.zeros(n, np.int64)
    for r, w in zip(rows, weight):
        total[doc[row == r]] += w * impact[row == r]
    order = np.lexsort((np.arange(n), -total))[:10]
    assert (best.id == order).all() and (best.score == total[order]).all()
    assert sum(opened) < n // 2
