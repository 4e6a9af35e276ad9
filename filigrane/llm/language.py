"""Language ID by hierarchical discrimination: the family first, then one-versus-one linear SVMs inside it."""
from __future__ import annotations

import re
from collections.abc import Mapping
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane.llm.common import base, blocks, id_out, map_arrow

#: Language codes of the larger families of Europe. Any other code is a family of its own.
FAMILIES = {"germanic": "en de nl sv da no nb nn is af fy lb", "romance": "fr es it pt ca ro gl oc",
            "slavic": "ru uk be pl cs sk bg sr hr sl mk bs", "baltic": "lt lv", "uralic": "fi et hu", "celtic": "ga cy gd br"}
UNKNOWN = "und"
DIM = 1 << 12
#: Labelled documents to learn from, per language, in expectation (a hash of the id selects them).
SAMPLE = 400
LETTER = re.compile(r"[^\W\d_]")

_KEEP = np.zeros(256, np.uint8) + 32
for _c in [*range(ord("a"), ord("z") + 1), *range(128, 256)]:
    _KEEP[_c] = _c
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), lang)


def features(texts: list[str]) -> np.ndarray:
    """Rows of hashed byte trigram counts of the whole texts; every run of other than letters is a blank."""
    raw = [t.lower().encode() for t in texts]
    joined = np.frombuffer(b"   ".join(raw) + b"   ", np.uint8)
    lengths = np.array([len(r) + 3 for r in raw])
    b = _KEEP[joined].astype(np.uint32)
    h = (b[:-2] * _MULT[0] + b[1:-1] * _MULT[1] + b[2:] * _MULT[2])
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    blank = b == 32
    use = ~(blank[1:-1] & (blank[:-2] | blank[2:]))
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)[:-2]
    cell = doc[use] * DIM + (h >> np.uint32(20))[use]
    return np.bincount(cell, minlength=len(texts) * DIM).reshape(len(texts), DIM)


def unit(counts: np.ndarray) -> np.ndarray:
    """Square roots of the counts at length 1."""
    x = np.sqrt(counts, dtype=np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, steps: int = 300, c: float = 50.0) -> np.ndarray:
    """Linear SVM with squared hinge loss by accelerated gradient steps; y is -1 or 1, classes weigh the same. The last
    weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = prev = np.zeros(x.shape[1], np.float32)
    rate = 1.0 / (1.0 + 2.0 * c * 2.0)
    for k in range(steps):
        v = w + (k / (k + 3)) * (w - prev)
        slack = np.maximum(0, 1 - y * (x @ v))
        prev, w = w, v - rate * (v - 2 * c * (x.T @ (weight * slack * y)))
    return w


class Model:
    """families: names; prior: rows of log probabilities of the trigram cells per family; pairs: (a, b) -> weights."""

    def __init__(self, counts: dict[str, np.ndarray], pairs: dict[tuple[str, str], np.ndarray]):
        self.langs = sorted(counts)
        self.pairs = pairs
        self.families = sorted({family_of(x) for x in self.langs})
        total = [sum(counts[x] for x in self.langs if family_of(x) == f).astype(float) + 0.5 for f in self.families]
        self.log = np.log(np.array([t / t.sum() for t in total])).astype(np.float32)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        counts = features(texts)
        n = np.maximum(1, counts.sum(axis=1))
        # the logits of a long text are those of a typical hundred trigrams
        like = (counts.astype(np.float32) @ self.log.T) * (np.minimum(n, 100) / n)[:, None]
        like -= like.max(axis=1, keepdims=True)
        share = np.exp(like)
        share /= share.sum(axis=1, keepdims=True)
        first = like.argmax(axis=1)
        x = unit(counts)
        lang, score = np.empty(len(texts), object), share[np.arange(len(texts)), first].astype(float)
        for k, f in enumerate(self.families):
            own = [v for v in self.langs if family_of(v) == f]
            at = np.flatnonzero(first == k)
            if not len(at):
                continue
            votes = np.zeros((len(at), len(own)))
            sure = np.zeros((len(at), len(own), len(own)))
            for i, j in combinations(range(len(own)), 2):
                w = self.pairs[own[i], own[j]]
                p = 1 / (1 + np.exp(-2.0 * np.clip(x[at] @ w[:-1] + w[-1], -30, 30)))
                sure[:, i, j], sure[:, j, i] = p, 1 - p
                votes[:, i] += (p >= 0.5) + 1e-3 * p
                votes[:, j] += (p < 0.5) + 1e-3 * (1 - p)
            best = votes.argmax(axis=1)
            lang[at] = np.array(own, object)[best]
            if len(own) > 1:
                won = sure[np.arange(len(at)), best]
                won[np.arange(len(at)), best] = 1
                score[at] *= won.min(axis=1)
        return list(lang), list(np.clip(score, 0, 1))


def _sample(batches):
    for b in batches:
        for labels, texts in blocks(iter([b])):
            c = features(texts)
            yield {"lang": labels, "counts": [r.astype(np.int32).tobytes() for r in c]}


def _learn(rows: pd.DataFrame) -> pd.DataFrame:
    """One task of the training: the two languages of a pair, or one language's counts."""
    task = rows["task"].iloc[0]
    x = np.array([np.frombuffer(c, np.int32) for c in rows["counts"]])
    if "\t" not in task:
        return pd.DataFrame({"task": [task], "model": [x.sum(axis=0, dtype=np.int64).tobytes()]})
    y = np.where(rows["lang"].to_numpy() == task.split("\t")[0], 1.0, -1.0).astype(np.float32)
    return pd.DataFrame({"task": [task], "model": [fit_svm(unit(x), y).tobytes()]})


def learn(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
          sample: int = SAMPLE) -> Model | None:
    """A model from labelled documents: about `sample` of each language, chosen by a hash of the id, each with its
    whole text. Languages and the pairs inside families are learned in tasks of their own; what comes to the driver is
    one vector for each. None if no row has a label."""
    known = docs.where(F.col(label_col).isNotNull() & (F.col(label_col) != "")).select(
        F.col(label_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        F.crc32(F.concat(F.lit("sample "), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")).alias("_h"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    tasks = {x: [x] + ["\t".join(sorted((x, o))) for o in sizes if o != x and family_of(o) == family_of(x)] for x in sizes}
    limit = F.element_at(F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, sample / n))]), F.col("lang"))
    chosen = known.where(F.col("_h") <= limit * (2.0 ** 32)).select("lang", "_text")
    deal = F.element_at(F.create_map(*[c for k, t in tasks.items() for c in (F.lit(k), F.array(*map(F.lit, t)))]), F.col("lang"))
    rows = map_arrow(chosen, _sample, "lang string, counts binary").withColumn("task", F.explode(deal))
    got = {r["task"]: r["model"] for r in rows.groupBy("task").applyInPandas(_learn, "task string, model binary").collect()}
    counts = {t: np.frombuffer(m, np.int64) for t, m in got.items() if "\t" not in t}
    none = np.zeros(DIM + 1, np.float32)
    pairs = {tuple(sorted((a, b))): np.frombuffer(got["\t".join(sorted((a, b)))], np.float32)
             if "\t".join(sorted((a, b))) in got else none
             for a, b in combinations(sorted(counts), 2) if family_of(a) == family_of(b)}
    return Model(counts, pairs) if counts else None


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1): one row per row of docs, from the whole texts alone.

    The family has the highest probability under the trigram counts of its languages; inside it every pair of languages
    has a linear SVM and the language with most votes wins (ties: the larger sum of certainties). The score is the
    family's probability times the weakest vote for the winner. A text without a letter (null and empty ones too) is
    'und' with score 0, as is every text when there was nothing to learn from. A null id stays null, repeated rows give
    repeated results, empty input gives an empty result."""
    def run(batches):
        for ids, texts in blocks(batches):
            lang, score = judged(texts, model)
            yield {"_id": ids, "lang_pred": lang, "score": score}
    return map_arrow(base(docs, id_col, text_col), run, "_id long, lang_pred string, score double").select(
        id_out(), "lang_pred", "score")


def judged(texts: list[str], model: Model | None) -> tuple[list[str], list[float]]:
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    at = [k for k, t in enumerate(texts) if (m := LETTER.search(t)) and (m[0].isalpha() or any(map(str.isalpha, t)))]
    for start in range(0, len(at) if model else 0, 256):
        part = at[start:start + 256]
        for k, v, s in zip(part, *model.predict([texts[k] for k in part])):
            lang[k], score[k] = v, float(s)
    return lang, score


def keep_known(docs: DataFrame, model: Model | None, min_score: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language is known with at least `min_score`, judged where they are read."""
    def run(batches):
        for b in batches:
            mask: list[bool] = []
            numbered = pa.RecordBatch.from_arrays(
                [pa.array(range(b.num_rows)), b.column(b.schema.get_field_index(text_col)).fill_null("")], names=["k", "t"])
            for _, texts in blocks(iter([numbered])):
                mask += [v != UNKNOWN and s >= min_score for v, s in zip(*judged(texts, model))]
            yield b.filter(pa.array(mask, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
