"""What a Python worker holds while it reads texts."""
from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from filigrane.llm import decontaminate, words


def test_frequencies_hold_a_small_block(monkeypatch):
    """Eight million characters in one batch: the arrays of a step stay far below the 3000 MB that an executor has for all."""
    monkeypatch.setattr(words, "_POWERS", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    texts = [f"word{k % 97} of some{k % 13} text " * 100 for k in range(3500)]
    batch = pa.record_batch([pa.array(range(3500), pa.int64()), pa.array(texts)], names=["_id", "_text"])
    terms = np.unique(words.hash_words(["word5 text"])[0])
    tracemalloc.start()
    got = list(decontaminate._frequencies(terms)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(got[0]["n"].tolist()) == [sum(k % 97 == 5 for k in range(3500)), 3500]
    assert peak < 100e6
