"""Fill-in-middle: a Fenwick tree over fixed blocks of a text finds the cuts, the parts are set in another order."""
from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigrane.llm.common import BLOCK_BYTES, NO_ID, base, id_out, map_arrow

#: What stands before prefix, suffix and middle in an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: Bytes of a block. A cut costs the depth of the tree and one look into one block.
BLOCK = 2048
UNITS = ("line", "char")


class BlockTree:
    """Unit ends and code points of every block of a UTF-8 text, as two Fenwick trees over the same blocks.

    A line ends at its newline, the last one at the end of the text; with unit 'char' every code point is a unit."""

    def __init__(self, raw: bytes, unit: str = "line", block: int = BLOCK):
        if unit not in UNITS:
            raise ValueError(f"unit must be one of {UNITS}, not {unit!r}")
        self.data = np.frombuffer(raw, np.uint8)
        self.unit, self.block = unit, block
        starts = np.arange(0, len(raw), block)
        points = self._points(self.data)
        ends = points if unit == "char" else self.data == 10
        if unit == "line" and len(raw) and raw[-1] != 10:
            ends = ends.copy()
            ends[-1] = True
        per = [np.add.reduceat(x, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64) for x in (ends, points)]
        self.units, self.points = (int(x.sum()) for x in per)
        self.size = len(starts)
        self.tree = np.stack([self._fenwick(x) for x in per], axis=1)

    @staticmethod
    def _points(data: np.ndarray) -> np.ndarray:
        """Bytes at which a code point begins."""
        return (data & 0xC0) != 0x80

    @staticmethod
    def _fenwick(counts: np.ndarray) -> np.ndarray:
        """Place k holds the sum of the k & -k blocks that end with block k (from 1)."""
        sums = np.concatenate([[0], np.cumsum(counts)])
        k = np.arange(len(sums))
        return sums[k] - sums[k - (k & -k)]

    def cut(self, units: int) -> tuple[int, int]:
        """(byte, code points) behind the first `units` units. The descent halves its stride: it steps over a stretch of
        blocks while their unit ends stay below the wanted number, and so ends before the block that holds the cut."""
        if units <= 0:
            return 0, 0
        if units >= self.units:
            return len(self.data), self.points
        at, left, seen = 0, units, 0
        for k in range(self.size.bit_length() - 1, -1, -1):
            there = at + (1 << k)
            if there <= self.size and self.tree[there, 0] < left:
                at = there
                left -= int(self.tree[there, 0])
                seen += int(self.tree[there, 1])
        first = at * self.block
        # a code point may run into the next block: up to three bytes more
        part = self.data[first:first + self.block + 3]
        heads = self._points(part)
        if self.unit == "char":
            where = np.flatnonzero(heads)
            stop = int(where[left]) if left < len(where) else len(part)
        else:
            stop = int(np.flatnonzero(part == 10)[left - 1]) + 1
        return first + stop, seen + int(np.count_nonzero(heads[:stop]))


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned numbers of 32 bits from the seed and the id; a null id counts as empty."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]


def rearrange(text: str, doc_id: int | None, rate: int, spm: int, seed: int, unit: str, block: int = BLOCK) -> dict:
    """One text cut and set anew; see fill_in_middle."""
    raw = text.encode()
    tree = BlockTree(raw, unit, block)
    h = draws(seed, doc_id)
    out = {"n": tree.units, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": text}
    if not raw or any(s in text for s in SENTINELS) or h[2] % 100 >= rate:
        return out
    first, second = sorted(x % (tree.units + 1) for x in h[:2])
    (a, prefix), (b, upto) = tree.cut(first), tree.cut(second)
    head, mid, tail = raw[:a].decode(), raw[a:b].decode(), raw[b:].decode()
    form = "spm" if h[3] % 100 < spm else "psm"
    parts = [SUFFIX, tail, PREFIX, head, MIDDLE, mid] if form == "spm" else [PREFIX, head, SUFFIX, tail, MIDDLE, mid]
    return out | {"form": form, "prefix_chars": prefix, "middle_chars": upto - prefix, "output": "".join(parts)}


COLUMNS = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 100, spm: int = 50, seed: int = 7,
                   unit: str = "line") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row per row of docs.

    `rate` percent of the texts are cut at two places after whole units ('line' or 'char'); `spm` percent of these take the
    order suffix, prefix, middle, the others prefix, suffix, middle. Cuts, rate and order follow from `seed` and the id alone,
    so repeated rows give repeated results. n counts the units, prefix_chars and middle_chars code points.

    A null text is empty and an empty text is plain, as is one that already holds a sentinel; plain texts have no
    prefix_chars and middle_chars. A null id stays null and draws as the empty string. Empty input gives an empty result. Each text is handled on its
    own in one pass without a shuffle; memory is a few times the longest text."""
    def run(batches):
        for b in batches:
            held, size = [], 0
            for k in range(b.num_rows):
                i, text = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                held.append((i, rearrange(text, None if i == NO_ID else i, rate, spm, seed, unit)))
                size += len(text)
                if size > BLOCK_BYTES or k + 1 == b.num_rows:
                    yield {"_id": [i for i, _ in held]} | {c: [r[c] for _, r in held] for c in COLUMNS}
                    held, size = [], 0
    schema = ", ".join(f"{c} {t}" for c, t in ({"_id": "long"} | COLUMNS).items())
    return map_arrow(base(docs, id_col, text_col), run, schema).select(id_out(), *COLUMNS)


def restored(output: str | Column, form: str | Column) -> Column:
    """The text an output was made from. The parts hold no sentinel, so each sentinel is the first of its kind."""
    out = F.col(output) if isinstance(output, str) else output
    kind = F.col(form) if isinstance(form, str) else form

    def between(first: str, then: str) -> Column:
        a = F.locate(first, out) + F.lit(len(first))
        return F.substring(out, a, F.locate(then, out) - a)
    last = F.substring(out, F.locate(MIDDLE, out) + F.lit(len(MIDDLE)), F.length(out))
    return (F.when(kind == "psm", F.concat(between(PREFIX, SUFFIX), last, between(SUFFIX, MIDDLE)))
            .when(kind == "spm", F.concat(between(PREFIX, MIDDLE), last, between(SUFFIX, PREFIX))).otherwise(out))
