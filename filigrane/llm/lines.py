"""Line dedup with two Bloom filters: once seen and twice seen. Only suspected repeats are shuffled."""
from __future__ import annotations

import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane.llm.common import base, checkpointed, id_out, map_arrow

BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
MIN_CHARS = 20
MIN_DOCS = 3
BITS_PER_LINE = 12
#: Upper bound of a filter (64 MB). Beyond it more lines are suspected and confirmed exactly; results do not change.
MAX_BITS = 1 << 29
PAGE = 1 << 13  # bytes of a filter that travel together


def line_keys(text: str) -> list[bytes | None]:
    """The key of every line, None where it is shorter than MIN_CHARS code points."""
    out = []
    for line in text.encode().lower().split(b"\n"):
        k = line.strip(BLANK)
        out.append(k if len(k) >= MIN_CHARS and (len(k) >= 4 * MIN_CHARS or len(k.decode()) >= MIN_CHARS) else None)
    return out


class TwiceFilter:
    """Bits of hashes seen in one document, and of those seen in two or more."""

    def __init__(self, bits: int):
        self.mask = np.uint64(bits - 1)
        self.once = np.zeros(bits // 8, np.uint8)
        self.twice = np.zeros(bits // 8, np.uint8)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return h & self.mask, (h >> np.uint64(31)) & self.mask

    @staticmethod
    def has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    @staticmethod
    def put(bits: np.ndarray, at: np.ndarray) -> None:
        at = np.unique(at)
        if len(at):
            byte, first = np.unique(at >> np.uint64(3), return_index=True)
            bits[byte] |= np.bitwise_or.reduceat(np.uint8(1) << (at & np.uint64(7)).astype(np.uint8), first)

    def add(self, h: np.ndarray) -> None:
        """Hashes of distinct keys per document, several documents at a time."""
        h, n = np.unique(h, return_counts=True)
        a, b = self.places(h)
        again = (n > 1) | (self.has(self.once, a) & self.has(self.once, b))
        self.put(self.twice, np.concatenate([a[again], b[again]]))
        self.put(self.once, np.concatenate([a, b]))

    def suspects(self, h: np.ndarray) -> np.ndarray:
        a, b = self.places(h)
        return self.has(self.twice, a) & self.has(self.twice, b)


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)


def _pages(bits: int):
    def run(batches):
        f, held, n = TwiceFilter(bits), [], 0
        for b in batches:
            for t in b.column(1):
                held.append(_hashes(set(filter(None, line_keys(t.as_py())))))
                n += len(held[-1])
                if n > 200_000:
                    f.add(np.concatenate(held))
                    held, n = [], 0
        if held:
            f.add(np.concatenate(held))
        page = f.once.reshape(-1, min(PAGE, bits // 8))
        for p in np.flatnonzero(page.any(axis=1)):
            yield {"page": [int(p)], "once": [zlib.compress(page[p].tobytes(), 1)],
                   "twice": [zlib.compress(f.twice.reshape(page.shape)[p].tobytes(), 1)]}
    return run


def _merge(batches):
    held: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for p, once, twice in zip(*(c.to_pylist() for c in b.columns)):
            o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (once, twice))
            if p in held:
                h = held[p]
                h[1] |= t | (h[0] & o)
                h[0] |= o
            else:
                held[p] = [o.copy(), t.copy()]
    for p, (_, t) in held.items():
        if t.any():
            yield {"page": [p], "twice": [zlib.compress(t.tobytes(), 1)]}


def _suspects(f):
    def run(batches):
        twice = f.value
        flt = TwiceFilter(8 * len(twice))
        flt.twice = np.frombuffer(twice, np.uint8)
        for b in batches:
            ids, keys = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                own = list(set(filter(None, line_keys(t.as_py()))))
                if own:
                    for k in np.flatnonzero(flt.suspects(_hashes(own))):
                        ids.append(i)
                        keys.append(own[k])
            yield {"_id": ids, "_key": keys}
    return run


def _apply(batches):
    for b in batches:
        n, dropped, kept = [], [], []
        for t, drop in zip(b.column(1), b.column(2).to_pylist()):
            t = t.as_py()
            lines = t.split("\n")
            if drop:
                drop = set(drop)
                lines = [x for x, k in zip(lines, line_keys(t)) if k not in drop]
            n.append(t.count("\n") + 1)
            dropped.append(n[-1] - len(lines))
            kept.append("\n".join(lines) if drop else t)
        yield {"_id": b.column(0), "n_lines": n, "n_dropped": dropped, "kept": kept}


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text that stays), one row per row of docs.

    A line's key is the line stripped of blanks with A-Z in lower case. Keys of 20 code points or more that at least
    `min_docs` documents hold lose all their lines except in the largest id holding them.

    Every task fills a pair of filters with the hashes of its lines; pages of the filters are merged (twice seen: in
    both, or in either's second filter) and the twice-seen filter is broadcast. Its size follows the number of lines up
    to `max_bits`, which bounds the broadcast. Lines that it suspects are shuffled and counted by their whole key, with
    partial counts per task; false suspects drop out there. The document texts move once, to meet their verdicts.

    Null and empty texts are one empty line. Two rows are two documents even if they share an id; the lines stay in
    every row that has the largest id. A null id sorts first. Empty input gives an empty result."""
    spark = docs.sparkSession
    rows = base(docs, id_col, text_col)
    lines = rows.agg(F.sum(F.length("_text") - F.length(F.replace("_text", F.lit("\n"))) + 1)).first()[0] or 0
    bits = min(max_bits, 1 << max(16, (BITS_PER_LINE * lines - 1).bit_length()))
    pages = map_arrow(rows, _pages(bits), "page long, once binary, twice binary")
    merged = map_arrow(pages.repartition("page"), _merge, "page long, twice binary").toLocalIterator()
    twice = np.zeros(bits // 8, np.uint8)
    size = min(PAGE, bits // 8)
    for p, t in merged:
        twice[p * size:(p + 1) * size] = np.frombuffer(zlib.decompress(t), np.uint8)
    found = checkpointed(map_arrow(rows, _suspects(spark.sparkContext.broadcast(twice.tobytes())), "_id long, _key binary"))
    # A written table also lets the join split the rows of a line that a third of the documents hold.
    repeated = checkpointed(found.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_last"))
                            .where(F.col("_n") >= min_docs))
    drops = (found.join(repeated, "_key").where("_id <> _last")
             .groupBy("_id").agg(F.collect_set("_key").alias("_drop")))
    out = map_arrow(rows.join(drops, "_id", "left"), _apply, "_id long, n_lines long, n_dropped long, kept string")
    return out.select(id_out(), "n_lines", "n_dropped", "kept")


