"""Steps of the removal of repeated byte strings: blocks of texts, and how many rows the suspects are."""
from __future__ import annotations

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from filigrane.llm import repeats


def test_windows_of_joined_texts_stay_in_their_text():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 100, n, np.uint8)) for n in (0, 49, 50, 51, 400, 3, 120)]
    _, first, n, h = repeats.windows(texts)
    piece, begin = repeats._piece_of(texts, first)
    alone = [(k, int(f), int(m), int(x)) for k, t in enumerate(texts) for _, fs, ns, hs in repeats.sections(t) for f, m, x in zip(fs, ns, hs)]
    assert [(int(p), int(f - begin[p]), int(m), int(x)) for p, f, m, x in zip(piece, first, n, h)] == alone
    assert n.sum() == sum(max(0, len(t) - 49) for t in texts)


def test_suspects_are_a_row_per_route_and_part():
    """Four thousand documents that share anchors in each of 32 buckets: not a row for each of them and bucket."""
    ids, one = np.arange(4000, dtype=np.int64), np.ones(4000, np.uint32)
    routes = [{"route": k, "bucket": k, "kind": 0, "ids": zlib.compress(np.diff(ids, prepend=0).tobytes()), "counts": zlib.compress(one.tobytes()),
               "anchors": np.repeat(np.arange(2000, dtype=np.uint32), 2).tobytes()} for k in range(32)]
    got = list(repeats._suspect(iter([pa.RecordBatch.from_pylist(routes)])))
    made = sum(len(next(iter(g.values()))) for g in got)
    assert 0 < made <= 32 * 512


def test_constant_least_ids_need_eight_bytes():
    assert len(repeats._packed(np.full(29, 7))) == 8 and len(repeats._packed(np.arange(2))) > 8


def test_gathering_holds_a_small_block():
    """Twenty million bytes in one batch: what a worker holds to list their anchors stays far below the 3000 MB of an executor."""
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(97, 123, 20_000))) for _ in range(1000)]
    batch = pa.record_batch([pa.array(range(1000), pa.int64()), pa.array(texts)], names=["_id", "_text"])
    tracemalloc.start()
    made = sum(len(r["ids"]) for r in repeats._gather(6)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made > 0
    assert peak < 110e6
