"""Op 5's buckets are even, and suspects of one bucket do not meet in one task."""
from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa

from filigrane.llm import repeats as R


def text(rng, n):
    return "".join(map(chr, rng.integers(97, 123, n)))


def test_buckets_are_even():
    """Anchors are least hashes: by their upper bits a fifth of them were in one bucket of 64."""
    rng = np.random.default_rng(1)
    _, _, _, h = R.windows([text(rng, 300_000).encode()])
    count = np.bincount((R._short(h, 6) >> np.uint64(32)).astype(int), minlength=64)
    assert len(count) == 64 and count.max() < 1.3 * count.mean()


def test_suspects_of_one_passage_are_dealt_out():
    """A passage that all documents of many tasks share."""
    rng, same = np.random.default_rng(2), "one passage that every document of the table holds somewhere in it, word by word"
    routes, entries = Counter(), 0
    for task in range(12):
        docs = pa.RecordBatch.from_pydict({"_id": list(range(100 * task, 100 * task + 100)), "_text": [text(rng, 400) + same for _ in range(100)]})
        for row in R._gather(4)(iter([docs])):
            if row["kind"][0]:
                routes[row["route"][0]] += 1
                entries += 1
    assert entries > 12 and max(routes.values()) < entries / 2 and len(routes) > 8


def test_sorted_in_one_number_or_two():
    rng = np.random.default_rng(3)
    key, value = rng.integers(0, 50, 1000).astype(np.uint64), rng.integers(0, 9, 1000)
    want = sorted(zip(key.tolist(), value.tolist()))
    for bits in (6, 62):
        k, v = R._in_order(key, value, bits)
        assert list(zip(k.tolist(), v.tolist())) == want and v.dtype == value.dtype
    assert [len(x) for x in R._in_order(key[:0], value[:0], 6)] == [0, 0]


def test_numbers_of_eight_bytes():
    """Read in place, also from the middle of an array."""
    a = pa.array([np.int64(k).tobytes() for k in range(5)], pa.binary())
    assert R._longs(a).tolist() == [0, 1, 2, 3, 4] and R._longs(a.slice(2, 2)).tolist() == [2, 3] and len(R._longs(a.slice(0, 0))) == 0
