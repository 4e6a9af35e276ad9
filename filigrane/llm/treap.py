"""A K2-treap over a grid of terms and documents: a quadtree without its empty cells, each cell with its largest impact."""
from __future__ import annotations

import numpy as np

#: Number of set bits of a child mask.
_POP = np.array([bin(k).count("1") for k in range(16)], np.int64)
#: States a descent opens at once, at least; more when many are waiting.
BATCH = 64
_TOP_ID = np.iinfo(np.int64).max


class Best:
    """The k highest (score, id) seen so far, equal scores by ascending id."""

    def __init__(self, k: int):
        self.k = k
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        keep = np.lexsort((ids, -score))[:self.k]
        self.score, self.id = score[keep], ids[keep]

    def may(self, bound: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        """Whether something of at most `bound` with an id of at least `least_id` can still enter."""
        if len(self.score) < self.k:
            return bound > 0
        return (bound > self.score[-1]) | ((bound == self.score[-1]) & (least_id <= self.id[-1]))


def _spread(x: np.ndarray) -> np.ndarray:
    """Zeros between the bits of numbers below 2^31."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333),
                        (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x


class Treap:
    """Rows are terms, columns documents; a point is a term in a document with its impact. All levels lie in one array,
    the root first; a cell knows which of its four children hold points and where the first of them is."""

    def __init__(self, row: np.ndarray, col: np.ndarray, impact: np.ndarray, ids: np.ndarray):
        """At least one point, none twice. ids: of every column."""
        self.depth = max(1, int(row.max()).bit_length(), int(len(ids) - 1).bit_length())
        code = (_spread(row) << np.uint64(1)) | _spread(col)
        order = np.argsort(code)
        code, peak = code[order], impact[order].astype(np.int64)
        levels = [(np.zeros(len(code), np.uint8), np.zeros(len(code), np.int64), peak)]
        for _ in range(self.depth):
            parent = code >> np.uint64(2)
            first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
            bits = np.left_shift(1, (code & np.uint64(3)).astype(np.uint8)).astype(np.uint8)
            peak = np.maximum.reduceat(peak, first)
            levels.append((np.bitwise_or.reduceat(bits, first), first, peak))
            code = parent[first]
        levels.reverse()
        ends = np.cumsum([len(m) for m, _, _ in levels])
        self.mask = np.concatenate([m for m, _, _ in levels])
        self.child = np.concatenate([f + e for (_, f, _), e in zip(levels, ends)]).astype(np.int32)
        self.peak = np.concatenate([p for _, _, p in levels])
        low = np.full(1 << self.depth, _TOP_ID)
        low[:len(ids)] = ids
        self.low = [low]  # the least id of every range of columns, level by level
        while len(self.low[0]) > 1:
            self.low.insert(0, self.low[0].reshape(-1, 2).min(axis=1))
        self.low_at = np.cumsum([0] + [len(x) for x in self.low])
        self.low = np.concatenate(self.low)

    def search(self, rows: np.ndarray, weight: np.ndarray, best: Best) -> None:
        """Add to `best` the documents with the largest sums of weight times impact over the rows.

        A state is a range of columns with, for each row that has points there, the cell on the row's path. Its bound is the
        weighted sum of their peaks; the ranges with the highest bounds are halved first, all row paths going down together.
        A range whose bound cannot enter `best` any more is given up."""
        inside = rows < 1 << self.depth  # the grid ends behind the last row that has points
        rows, weight = rows[inside], weight[inside]
        state = _States.root(rows, weight, self.peak[0])
        while len(state):
            state = state.take(np.flatnonzero(best.may(state.bound, self._least(state))))
            if not len(state):
                break
            n = max(BATCH, len(state) // 4)
            rest = _States.none()
            if n < len(state):
                split = np.argpartition(-state.bound, n)
                rest = state.take(split[n:])
                state = state.take(split[:n])
            below = self._halves(state, rows, weight)
            done = below.level == self.depth
            if done.any():
                at = np.flatnonzero(done & (below.bound > 0))
                best.add(below.bound[at], self._least(below)[at])
                below = below.take(np.flatnonzero(~done))
            state = _States.both(rest, below)

    def _least(self, s: "_States") -> np.ndarray:
        return self.low[self.low_at[s.level] + s.col]

    def _halves(self, s: "_States", rows: np.ndarray, weight: np.ndarray) -> "_States":
        owner = np.repeat(np.arange(len(s)), s.size)
        down = (rows[s.term] >> (self.depth - 1 - s.level[owner])) & 1
        mask = self.mask[s.cell].astype(np.int64)
        out = _States.none()
        for half in (0, 1):
            quarter = 2 * down + half
            at = np.flatnonzero((mask >> quarter) & 1)
            if not len(at):
                continue
            cell = self.child[s.cell[at]] + _POP[mask[at] & ((1 << quarter[at]) - 1)]
            term, own = s.term[at], owner[at]
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            bound = np.add.reduceat(weight[term] * self.peak[cell], start)
            who = own[start]
            out = _States.both(out, _States(bound, s.level[who] + 1, 2 * s.col[who] + half,
                                            np.diff(np.append(start, len(at))), term, cell))
        return out


class _States:
    """Ranges of columns; term and cell of all of them lie one behind the other, `size` each."""

    def __init__(self, bound, level, col, size, term, cell):
        self.bound, self.level, self.col, self.size, self.term, self.cell = bound, level, col, size, term, cell

    def __len__(self) -> int:
        return len(self.bound)

    @staticmethod
    def none() -> "_States":
        return _States(*[np.zeros(0, np.int64)] * 6)

    @staticmethod
    def root(rows: np.ndarray, weight: np.ndarray, peak: int) -> "_States":
        n = len(rows)
        one = lambda x: np.array([x], np.int64)
        return _States(one(int(weight.sum()) * int(peak)), one(0), one(0), one(n), np.arange(n), np.zeros(n, np.int64)) if n else _States.none()

    @staticmethod
    def both(a: "_States", b: "_States") -> "_States":
        if not len(a) or not len(b):
            return a if len(a) else b
        return _States(*[np.concatenate(x) for x in zip(a.__dict__.values(), b.__dict__.values())])

    def take(self, at: np.ndarray) -> "_States":
        if len(at) == len(self) and np.array_equal(at, np.arange(len(self))):
            return self
        size = self.size[at]
        start = np.cumsum(self.size) - self.size
        where = np.repeat(start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return _States(self.bound[at], self.level[at], self.col[at], size, self.term[where], self.cell[where])
