"""Ranked lexical search: every item's best documents by BM25, from K2-treaps over blocks of documents."""
from __future__ import annotations

import math
import zlib
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigrane.llm.common import base, checkpointed, id_out, map_arrow
from filigrane.llm.treap import Best, Treap

#: Fixed values of the score: its scale and the length normalisation in hundredths.
SCALE, SATURATION, LENGTH = 1_000_000_000, 8, 90

#: A block is closed when it holds so many postings or documents; this bounds a task's memory.
BLOCK_POSTINGS = 1 << 20
BLOCK_DOCS = 1 << 16
#: Bytes of items that are searched at a time; more items come in further slices.
SLICE_BYTES = 32_000_000
#: A term in more items than this lies with the frequent ones, any other beside the terms of its item.
SHARED = 2

_SPLIT = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII; only A-Z are lower-cased."""
    return text.encode().translate(_SPLIT).split()


def term_weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """The part of the score that the weight multiplies, in whole numbers."""
    m = 100 - LENGTH + (LENGTH * length.astype(np.int64) * n) // total
    return (SCALE * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + SATURATION * m)


def _pack(x: np.ndarray, kind=np.int32) -> bytes:
    return zlib.compress(np.ascontiguousarray(x, kind).tobytes(), 1)


def _unpack(x: bytes, kind=np.int32) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


def index_blocks(docs: DataFrame, vocabulary) -> DataFrame:
    """Blocks of documents with their postings of the vocabulary (a broadcast dict of term to number).

    n, total: documents with a term and all their terms; ids, length: of the documents that hold a word of the vocabulary; doc, term, tf: the postings, packed;
    seen, df: the terms that occur and in how many documents."""
    def run(batches):
        known = vocabulary.value
        new = lambda: {"n": 0, "total": 0, "ids": [], "length": [], "count": [], "term": [], "tf": []}
        held = new()

        def row():
            term, seen, df = np.array(held["term"], np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(term):
                seen, df = np.unique(term, return_counts=True)
            return {"n": [held["n"]], "total": [held["total"]], "ids": [_pack(held["ids"], np.int64)],
                    "length": [_pack(held["length"], np.int64)], "count": [_pack(held["count"])], "term": [_pack(term)],
                    "tf": [_pack(held["tf"], np.int64)], "seen": [seen], "df": [df]}
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = terms(t.as_py())
                if not words:
                    continue
                held["n"] += 1
                held["total"] += len(words)
                hits = [(known[w], c) for w, c in Counter(words).items() if w in known]
                if hits:
                    held["ids"].append(i)
                    held["length"].append(len(words))
                    held["count"].append(len(hits))
                    held["term"] += [w for w, _ in hits]
                    held["tf"] += [c for _, c in hits]
                    if len(held["term"]) >= BLOCK_POSTINGS or len(held["ids"]) >= BLOCK_DOCS:
                        yield row()
                        held = new()
        if held["n"]:
            yield row()
    return map_arrow(docs, run, "n long, total long, ids binary, length binary, count binary, term binary, tf binary, "
                                "seen array<int>, df array<int>")


def _order(doc: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of the documents on the grid: alike lengths, then alike leading terms, lie together, so that the peaks of a
    range are near its documents' own."""
    lead = np.zeros(len(length), np.int64)
    by = np.lexsort((-term, tf, doc))
    last = np.flatnonzero(np.append(doc[by][1:] != doc[by][:-1], True))
    lead[doc[by][last]] = term[by][last]
    order = np.lexsort((length, lead, np.floor(2 * np.log2(length))))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place


def search_blocks(blocks: DataFrame, plan, k: int) -> DataFrame:
    """_item, _id, score: the k best of every item among the blocks of a task. plan: a broadcast of n, total, the items'
    terms and weights, and the row of every term."""
    def run(batches):
        n, total, items, row_of = plan.value
        best = [Best(k) for _ in items]
        for b in batches:
            for r in range(b.num_rows):
                ids, length, count, term, tf = (_unpack(b.column(c)[r].as_py(), t) for c, t in zip(
                    range(5), (np.int64, np.int64, np.int32, np.int32, np.int64)))
                if not len(term):
                    continue
                doc = np.repeat(np.arange(len(ids)), count)
                place = _order(doc, term, tf, length)
                by_place = np.empty(len(ids), np.int64)
                by_place[place] = ids
                treap = Treap(row_of[term], place[doc], impacts(tf, length[doc], n, total), by_place)
                for (rows, weight), top in zip(items, best):
                    treap.search(rows, weight, top)
        got = [(i, int(d), int(s)) for i, top in enumerate(best) for d, s in zip(top.id, top.score)]
        for a in range(0, len(got), 10_000):
            part = got[a:a + 10_000]
            yield {"_item": [x[0] for x in part], "_id": [x[1] for x in part], "score": [x[2] for x in part]}
    return map_arrow(blocks.select("ids", "length", "count", "term", "tf"), run, "_item int, _id long, score long")


def _rows(items: list[list[bytes]], number: dict[bytes, int], df: np.ndarray) -> np.ndarray:
    """Row of every term: frequent ones by falling document frequency, then those of the first item, of the second and so
    on, so that cells hold terms that occur together."""
    uses = Counter(w for ws in items for w in ws)
    first = {}
    for k, ws in enumerate(items):
        for w in ws:
            first.setdefault(w, k)
    order = sorted(number, key=lambda w: (uses[w] <= SHARED, first[w] if uses[w] <= SHARED else -int(df[number[w]]), number[w]))
    row = np.empty(len(order), np.int64)
    row[[number[w] for w in order]] = np.arange(len(order))
    return row


def _slice(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """_item (place in items), _id, score, rank."""
    spark = docs.sparkSession
    wanted = [list(dict.fromkeys(terms(t))) for _, t in items]
    number = {w: i for i, w in enumerate(dict.fromkeys(w for ws in wanted for w in ws))}
    blocks = checkpointed(index_blocks(docs, spark.sparkContext.broadcast(number)))
    n, total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    df = np.zeros(len(number), np.int64)
    pair = F.explode(F.arrays_zip("seen", "df")).alias("p")
    for r in blocks.select(pair).groupBy("p.seen").agg(F.sum("p.df").alias("df")).collect():  # one row per term of the items
        df[r["seen"]] = r["df"]
    row_of = _rows(wanted, number, df)
    weight = np.array([term_weight(n, int(x)) for x in df], np.int64)
    plan = []
    for ws in wanted:  # terms that no document holds have no rows, terms of weight 0 or less add nothing to a bound
        t = np.array([number[w] for w in ws if df[number[w]]], np.int64)
        plan.append((row_of[t], weight[t]))
    found = search_blocks(blocks, spark.sparkContext.broadcast((n, total, plan, row_of)), k).withColumn(
        "_salt", F.pmod(F.xxhash64("_id"), F.lit(64)))
    by = [F.desc("score"), F.asc("_id")]
    few = found.withColumn("_r", F.row_number().over(Window.partitionBy("_item", "_salt").orderBy(*by))).where(F.col("_r") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("_item").orderBy(*by))).where(F.col("rank") <= k)


def rank_documents(items: DataFrame, docs: DataFrame, k: int = 10, item_id: str = "item_id", item_text: str = "text",
                   id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest BM25 score above 0 for each row of items, equal scores
    by ascending doc_id.

    One pass over the documents writes the postings of the items' terms in blocks and counts documents, lengths and document
    frequencies over all of them; a second one builds a K2-treap per block and lets every item descend in it. A task hands on
    at most k rows per item. Items come in slices of about slice_bytes, each read by the driver and broadcast; every slice
    is searched in all documents.

    A null text has no terms, a null document id is null in the result and comes before all others among equal scores, a null
    item id stays null. Repeated rows, of items or of documents, are rows of their own. Items without known terms and empty tables give no rows."""
    docs = base(docs, id_col, text_col)
    asked = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("_t"))
    size = asked.agg(F.sum(F.octet_length("_t") + F.lit(64))).first()[0] or 0
    slices = -(-size // slice_bytes)
    kind = dict(asked.dtypes)["item_id"]
    schema = f"_item int, item_id {kind}"
    cut = F.pmod(F.xxhash64("item_id", "_t"), F.lit(max(1, slices)))
    out = []
    for s in range(slices):
        part = [tuple(r) for r in asked.where(cut == s).collect()]  # slice_bytes in expectation
        if part:
            names = docs.sparkSession.createDataFrame([(i, p[0]) for i, p in enumerate(part)], schema)
            found = _slice(docs, part, k).join(names, "_item")
            out.append(found if slices == 1 else checkpointed(found))
    if not out:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out).select("item_id", "rank", id_out(), "score")
