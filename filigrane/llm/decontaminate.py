"""Benchmark decontamination: a BM25 index of the test items, block-max WAND per training passage, exact overlap."""
from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane.llm.common import NO_ID, base, blocks, checkpointed, digest, id_out, map_arrow
from filigrane.llm.words import SHINGLE, hash_words, shingles

K1, B = 1.2, 0.75
#: Part of an item's own score that a passage has to reach to be retrieved.
THRESHOLD = 0.5
#: Part of the question's and of the answer's shingles that the passage has to hold.
OVERLAP = 0.8
BLOCK = 8
#: Items of one index; more items make more indexes, each a pass of its own, so a broadcast stays bounded.
SLICE_ITEMS = 20_000
SLICE_BYTES = 32_000_000
SENTENCE = re.compile(r"(?<=[.!?])\s+")


@dataclass
class Item:
    id: int
    words: np.ndarray
    question: tuple[int, np.ndarray]  # words per shingle, shingles
    answer: tuple[int, np.ndarray]


def parse(item_id: int, text: str) -> Item | None:
    """The answer is the last sentence, the question all before it; an item of one sentence is its own answer. None for
    an item without words."""
    parts = SENTENCE.split(text.strip())
    halves = [" ".join(parts[:-1]) or text, parts[-1]]
    w, at = hash_words([text, *halves])
    w, q, a = (w[at[k]:at[k + 1]] for k in range(3))
    if not len(w):
        return None
    q, a = (x if len(x) else w for x in (q, a))
    return Item(item_id, w, *((min(SHINGLE, len(x)), shingles(x)) for x in (q, a)))


class Index:
    """Postings of the items' terms with the impact of each, as a part of the item's own score, and block maxima."""

    def __init__(self, items: list[Item], df: dict[int, int], n_docs: int):
        self.items = items
        longest = max(len(i.words) for i in items)
        self.stride, self.width = longest, 2 * longest
        mean = sum(len(i.words) for i in items) / len(items)
        found: dict[int, list[tuple[int, float]]] = {}
        for k, item in enumerate(items):
            terms, tf = np.unique(item.words, return_counts=True)
            d = np.array([df.get(int(t), 0) for t in terms])
            idf = np.log(1 + (n_docs - np.minimum(d, n_docs) + 0.5) / (d + 0.5))
            gain = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(item.words) / mean))
            for t, g in zip(terms.tolist(), (gain / gain.sum()).tolist()):
                found.setdefault(t, []).append((k, g))
        self.terms = np.array(sorted(found), np.uint64)
        self.docs = [[k for k, _ in found[t]] for t in self.terms.tolist()]
        self.gains = [[g for _, g in found[t]] for t in self.terms.tolist()]
        self.tops = [[max(g[s:s + BLOCK]) for s in range(0, len(g), BLOCK)] for g in self.gains]
        self.best = np.array([max(g) for g in self.gains])
        # heavy postings by term: an item's light ones are its least gains, half a threshold together at most
        rest, light = [0.0] * len(items), set()
        for g, t, k in sorted((g, t, k) for t in range(len(self.docs)) for k, g in zip(self.docs[t], self.gains[t])):
            if rest[k] + g <= THRESHOLD / 2:
                rest[k] += g
                light.add((t, k))
        self.rest = np.array(rest)
        heavy = [[(k, g) for k, g in zip(d, gs) if (t, k) not in light] for t, (d, gs) in enumerate(zip(self.docs, self.gains))]
        self.heavy_n = np.array([len(h) for h in heavy])
        self.heavy_at = np.cumsum(self.heavy_n) - self.heavy_n
        self.heavy_item = np.array([k for h in heavy for k, _ in h], np.int64)
        self.heavy_gain = np.array([g for h in heavy for _, g in h])

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for words that no item has."""
        at = np.searchsorted(self.terms, words)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == words, at, -1)

    def passages(self, term: np.ndarray, at: np.ndarray, threshold: float):
        """(document, first word, end) of all passages that may reach the threshold: for some item the heavy terms
        in the passage and all its light ones come to it."""
        count = np.maximum(1, -(-(np.diff(at) - self.stride) // self.stride))
        first = np.cumsum(count) - count
        pos = np.flatnonzero((term >= 0) & (self.heavy_n[term] > 0))
        doc = np.searchsorted(at, pos, "right") - 1
        q = (pos - at[doc]) // self.stride
        here, before = q < count[doc], q > 0  # a word lies in two passages that overlap
        pair = np.unique(np.concatenate([(first[doc] + q)[here] * len(self.terms) + term[pos[here]],
                                         (first[doc] + q - 1)[before] * len(self.terms) + term[pos[before]]]))
        where, t = np.divmod(pair, len(self.terms))
        n = self.heavy_n[t]
        post = np.repeat(self.heavy_at[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell, back = np.unique(np.repeat(where, n) * len(self.items) + self.heavy_item[post], return_inverse=True)
        reach = np.bincount(back, self.heavy_gain[post], len(cell)) + self.rest[cell % len(self.items)]
        for p in np.unique(cell[reach >= threshold - 1e-9] // len(self.items)):
            d = int(np.searchsorted(first, p, "right")) - 1
            lo = at[d] + (p - first[d]) * self.stride
            yield d, lo, min(lo + self.width, at[d + 1])

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Every item whose terms among `terms` (distinct) sum up to the threshold: block-max WAND. The threshold is
        fixed, so all that reach it are found."""
        docs, gains, tops, best = self.docs, self.gains, self.tops, self.best
        # cursors: [current item, position, term]
        cur = [[docs[t][0], 0, t] for t in terms]
        out = []
        eps = 1e-9
        while cur:
            cur.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cur):
                bound += best[c[2]]
                if bound + eps >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            at = cur[pivot][0]
            while pivot + 1 < len(cur) and cur[pivot + 1][0] == at:
                pivot += 1
            ahead = cur[:pivot + 1]
            # the blocks that hold `at`: their maxima bound the score of every item up to the first block's end
            local, skip = 0.0, cur[pivot + 1][0] if pivot + 1 < len(cur) else len(self.items)
            for c in ahead:
                d = docs[c[2]]
                b = c[1] // BLOCK
                while d[min(len(d), (b + 1) * BLOCK) - 1] < at and (b + 1) * BLOCK < len(d):
                    b += 1
                end = d[min(len(d), (b + 1) * BLOCK) - 1]
                if end >= at:
                    local += tops[c[2]][b]
                    skip = min(skip, end + 1)
            if local + eps < threshold:
                goal = max(skip, at + 1)
            elif ahead[0][0] == at:
                score = sum(gains[c[2]][c[1]] for c in ahead)
                if score + eps >= threshold:
                    out.append((at, min(score, 1.0)))
                goal = at + 1
            else:
                goal = at
            moved = []
            for c in ahead:
                d, p = docs[c[2]], c[1]
                while p < len(d) and d[p] < goal:
                    p += 1
                if p < len(d):
                    moved.append([d[p], p, c[2]])
            cur = moved + cur[pivot + 1:]
        return out

    def verified(self, item: int, passage: np.ndarray, overlap: float) -> tuple[float, float] | None:
        """Parts of the question and of the answer that the passage holds, if both reach the overlap."""
        i = self.items[item]
        q, a = (self._held(part, passage) for part in (i.question, i.answer))
        return (q, a) if q >= overlap and a >= overlap else None

    def _held(self, part: tuple[int, np.ndarray], passage: np.ndarray) -> float:
        n, s = part
        return float(np.isin(s, shingles(passage, n)).mean()) if len(passage) >= n else 0.0


def _slices(benchmark: DataFrame, item_col: str, text_col: str):
    """Lists of items, each small enough to broadcast."""
    part, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    for r in rows.orderBy("i", "t").toLocalIterator():
        if (item := parse(r["i"], r["t"])) is None:
            continue
        if part and (len(part) >= SLICE_ITEMS or size + len(r["t"]) > SLICE_BYTES):
            yield part
            part, size = [], 0
        part.append(item)
        size += len(r["t"])
    if part:
        yield part


def _frequencies(terms: np.ndarray):
    def run(batches):
        n = np.zeros(len(terms), np.int64)
        for _, texts in blocks(batches):
            w, at = hash_words(texts)
            k = np.searchsorted(terms, w)
            k[k == len(terms)] = 0
            hit = terms[k] == w
            doc = np.repeat(np.arange(len(texts)), np.diff(at))[hit]
            n += np.bincount(np.unique(doc * len(terms) + k[hit]) % len(terms), minlength=len(terms))
        at = np.flatnonzero(n)
        yield {"term": at, "n": n[at]}
    return run


def _retrieve(index, threshold: float, overlap: float):
    def run(batches):
        ix: Index = cloudpickle.loads(index.value)
        for ids, texts in blocks(batches):
            w, at = hash_words(texts)
            term = ix.lookup(w)
            out: dict[str, list] = {"_id": [], "_td": [], "item": [], "score": [], "question": [], "answer": []}
            best: dict[tuple[int, int], tuple] = {}
            for d, lo, hi in ix.passages(term, at, threshold):
                t = term[lo:hi]
                for item, score in ix.search(np.unique(t[t >= 0]).tolist(), threshold):
                    ok = ix.verified(item, w[lo:hi], overlap)
                    if ok and (score, *ok) > best.get((d, item), ()):
                        best[d, item] = (score, *ok)
            for (d, item), found in best.items():
                for name, v in zip(out, (ids[d], hashlib.md5(texts[d].encode()).hexdigest(), ix.items[item].id, *found)):
                    out[name].append(v)
            if out["_id"]:
                yield out
    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """_id, _td (md5 of the text), item, score, question, answer: a row for each benchmark item that a document contains.

    Items with a null id or text or without words are left out. Terms weigh by their document frequency in all of docs.
    The passages of a document are windows of twice the longest item's words that overlap by half, so any item lies
    whole in one. Impacts are parts of the item's own BM25 score, so one threshold holds for items of all lengths."""
    spark = docs.sparkSession
    rows = base(docs, id_col, text_col)
    out = None
    for items in _slices(benchmark, item_col, item_text):
        terms = np.unique(np.concatenate([i.words for i in items]))
        df = (map_arrow(rows, _frequencies(terms), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())
        index = Index(items, {int(terms[r["term"]]): r["n"] for r in df}, rows.count())
        found = map_arrow(rows, _retrieve(spark.sparkContext.broadcast(cloudpickle.dumps(index)), threshold, overlap),
                          "_id long, _td string, item long, score double, question double, answer double")
        out = checkpointed(found if out is None else out.unionByName(found))
    if out is None:
        return spark.createDataFrame([], "_id long, _td string, item long, score double, question double, answer double")
    return out


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, contaminated, n_items, items (ascending, comma-joined), score (the best): one row per row of docs.

    Null and empty texts are clean. Rows that share an id, or have none, are judged each by its own text. Without usable benchmark items all
    documents are clean. Empty input gives an empty result."""
    hits = (leaks(docs, benchmark, id_col, text_col, **options).groupBy("_id", "_td")
            .agg(F.array_join(F.array_sort(F.collect_set("item")), ",").alias("items"),
                 F.count_distinct("item").alias("n_items"), F.max("score").alias("score")))
    ids = base(docs, id_col, text_col).select("_id", digest("_text").alias("_td"))
    return (ids.join(hits, ["_id", "_td"], "left")
            .select(id_out(), F.col("items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
                    F.coalesce("items", F.lit("")).alias("items"), F.coalesce("score", F.lit(0.0)).alias("score")))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    bad = leaks(docs, benchmark, id_col, text_col, **options).select("_id", "_td").distinct()
    key = F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID))
    return docs.join(bad, (key == bad["_id"]) & (digest(text_col) == bad["_td"]), "left_anti")
