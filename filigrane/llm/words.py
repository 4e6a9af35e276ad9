"""Words and shingles of texts as 64-bit hashes, vectorised over many texts at a time."""
from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_WORD = np.zeros(256, bool)
for _c in [*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]:
    _WORD[_c] = True
SHINGLE = 5


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept between calls."""
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, _INV)):
            p = np.full(1 << (n - 1).bit_length(), b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def hash_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets of the texts). Words are runs of ASCII letters and digits and of anything
    beyond ASCII, in lower case. A word's hash depends on its bytes alone: differences of a running polynomial."""
    raw = [t.lower().encode() for t in texts]
    b = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = _WORD[b]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    start, end = edge[0::2], edge[1::2]
    h = span_hashes(b, start, end)
    bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
    return h, np.searchsorted(start, bounds)


def span_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings b[start:end]."""
    up, down = _powers(len(b) + 1)
    run = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1], out=run[1:])
    return mix((run[end] - run[start]) * down[start])


def shingles(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; a text of fewer words has one shingle of all of them, one without
    words has none."""
    if len(h) == 0:
        return h
    n = min(n, len(h))
    s = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        s = s * np.uint64(_BASE) + h[k:len(h) - n + 1 + k]
    return np.unique(mix(s))
