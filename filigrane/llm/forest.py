"""N-gram Jaccard join: a MinHash LSH forest proposes groups, pairs inside them are verified exactly."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane.llm.common import base, blocks, checkpointed, digest, groups, id_out, kept_rows, map_arrow
from filigrane.llm.words import SHINGLE, hash_words, mix, shingles
from filigrane.operators.network import connected_components

SIMILARITY = 0.8
TREES = 24
#: Hashes of a full signature in one tree, the deepest level of its prefix trie.
DEPTH = 8
#: Chance that a pair just at the threshold shares a trie node.
RECALL = 0.99999
#: A group is cut into blocks of about so many documents and shingles; every two blocks make a tile.
TILE_DOCS, TILE_SHINGLES = 384, 1 << 21


def prefix_length(similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Start from whole signatures and shorten the matched prefix until a pair at the threshold meets in some tree with
    the target recall."""
    for k in range(depth, 1, -1):
        if 1 - (1 - similarity ** k) ** trees >= recall:
            return k
    return 1


class Signer:
    """Trie nodes of documents: per tree a hash of the first `length` minimum hashes of its signature."""

    def __init__(self, trees: int, length: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees, self.length = trees, length
        self.a = rng.integers(1, 1 << 31, trees * length, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, trees * length, dtype=np.uint64).astype(np.uint32)

    def nodes(self, words: np.ndarray, at: np.ndarray, n: int = SHINGLE) -> np.ndarray:
        """A row of `trees` node hashes per document; documents without words get rows of zeros."""
        sizes = np.diff(at)
        out = np.zeros((len(sizes), self.trees), np.uint64)
        long = np.flatnonzero(sizes >= n)
        parts, counts, docs = [], [], []
        if len(long):
            s = np.zeros(len(words) - n + 1, np.uint64)
            for k in range(n):
                s = s * np.uint64(0x9E3779B97F4A7C15) + words[k:len(words) - n + 1 + k]
            first = np.concatenate([[0], np.cumsum(sizes[long] - n + 1)])[:-1]
            take = np.ones(first[-1] + sizes[long[-1]] - n + 1, np.int64)
            take[first[0]] = at[long[0]]
            take[first[1:]] = at[long[1:]] - (at[long[:-1]] + sizes[long[:-1]] - n)
            parts.append(mix(s[np.cumsum(take)]))
            counts.append(sizes[long] - n + 1)
            docs.append(long)
        for d in np.flatnonzero((sizes > 0) & (sizes < n)):
            parts.append(shingles(words[at[d]:at[d + 1]], n))
            counts.append(np.ones(1, np.int64))
            docs.append(np.array([d]))
        if not parts:
            return out
        h = (np.concatenate(parts) >> np.uint64(32)).astype(np.uint32)
        docs = np.concatenate(docs)
        first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])[:-1]
        for t in range(self.trees):
            node = np.full(len(docs), t + 1, np.uint64)
            for j in range(t * self.length, (t + 1) * self.length):
                node = mix(node * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(h * self.a[j] + self.b[j], first))
            out[docs, t] = node
        return out


def _sign(signer: Signer):
    def run(batches):
        for ids, texts in blocks(batches):
            w, at = hash_words(texts)
            nodes = signer.nodes(w, at).view(np.int64)
            yield {"_id": ids, "_td": [hashlib.md5(t.encode()).hexdigest() for t in texts], "n": np.diff(at),
                   "_c": [xxhash.xxh3_128_digest(w[a:b].tobytes()) if b > a else None for a, b in zip(at, at[1:])],
                   "nodes": pa.FixedSizeListArray.from_arrays(nodes.ravel(), signer.trees).cast(pa.list_(pa.int64()))}
    return run


def _deal(signer: Signer):
    """Send each document to its tiles, with its nodes and shingles."""
    def run(batches):
        for b in batches:
            want = b.column(2).to_pylist()
            asked = b.column(3).to_pylist()
            k = 0
            for ids, texts in blocks(iter([b])):
                w, at = hash_words(texts)
                nodes = signer.nodes(w, at)
                out: dict[str, list] = {"tile": [], "tree": [], "side": [], "_c": [], "nodes": [], "shingles": []}
                size = 0
                for d in range(len(ids)):
                    own = w[at[d]:at[d + 1]]
                    if xxhash.xxh3_128_digest(own.tobytes()) == want[k]:
                        s = shingles(own).tobytes()
                        for g in asked[k]:
                            for other in range(g["blocks"]):
                                lo, hi = sorted((g["block"], other))
                                for name, v in zip(out, (f"{g['node']}.{lo}.{hi}", g["tree"], 0 if g["block"] == lo else 1, want[k],
                                                         nodes[d].tobytes(), s)):
                                    out[name].append(v)
                                size += len(s)
                                if size > 8_000_000:
                                    yield out
                                    out, size = {n: [] for n in out}, 0
                    k += 1
                if out["tile"]:
                    yield out
    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all two sets."""
    m = len(sets)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    rank = np.cumsum(new) - 1
    shared = np.bincount(rank) > 1
    use = shared[rank]
    rank, owner = (np.cumsum(shared) - 1)[rank[use]], owner[use]
    out = np.zeros((m, m), np.float32)
    step = 4096
    cuts = np.searchsorted(rank, np.arange(0, (rank[-1] + 1 if len(rank) else 0) + step, step))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        x = np.zeros((m, step), np.float32)
        x[owner[a:b], rank[a:b] - k * step] = 1
        out += x @ x.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _verify(similarity: float):
    def run(batches):
        out: dict[str, list] = {"_c": [], "root": [], "links": []}
        for g in groups(batches, "tile"):
            lo, hi = g.column("tile")[0].as_py().split(".")[1:]
            tree = g.column("tree")[0].as_py()
            seen = {c: k for k, c in reversed(list(enumerate(g.column("_c").to_pylist())))}
            names, rows = list(seen), list(seen.values())
            if len(rows) < 2:
                continue
            side = np.array(g.column("side").to_pylist())[rows]
            nodes = np.array([np.frombuffer(g.column("nodes")[r].as_py(), np.uint64) for r in rows])
            sets = [np.frombuffer(g.column("shingles")[r].as_py(), np.uint64) for r in rows]
            own = np.array([len(s) for s in sets], np.float32)
            inter = overlaps(sets)
            link = inter >= similarity * (own[:, None] + own[None, :] - inter) - 1e-6
            np.fill_diagonal(link, False)
            if lo != hi:
                link &= side[:, None] != side[None, :]
            for t in range(tree):  # a pair belongs to the first tree in which it meets
                link &= nodes[:, t][:, None] != nodes[:, t][None, :]
            if not link.any():
                continue
            root = np.arange(len(rows))
            while True:
                low = np.where(link, root[None, :], len(rows)).min(axis=1)
                low = np.minimum(root, low)
                low = low[low]
                if (low == root).all():
                    break
                root = low
            n = link.sum(axis=1)
            for k in np.flatnonzero(n):
                for name, v in zip(out, (names[k], names[root[k]], int(n[k]))):
                    out[name].append(v)
            if len(out["_c"]) > 5000:
                yield out
                out = {n: [] for n in out}
        if out["_c"]:
            yield out
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                    trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """doc_id, copy_of, class_id, n_links: one row per row of docs.

    Documents are sets of five-word shingles (words in lower case, without punctuation; a text of fewer words is one
    shingle). Documents with the same words in the same order are copies: copy_of is the smallest id among them, and
    only one of them goes on. n_links counts the other texts (one per group of copies) with a Jaccard similarity of at
    least `similarity`; class_id is the smallest id of the connected component of these links.

    Signatures live in tries, one per tree; the matched prefix is shortened from the whole signature until pairs at the
    threshold meet with the target recall. Trie nodes with two or more texts are the groups; groups of the same members
    in several trees are kept once. A large group is cut into blocks, each two blocks are one task's work, and no pair
    leaves its task: what comes out is a count and a root for each document. Pairs that meet in several trees count in
    the first one only.

    A text without words has no links and is its own class. A null id sorts first. Rows that repeat an id and a text
    are copies; rows that repeat an id with other texts are texts of their own. Empty input gives an empty result."""
    signed, verdict = _classes(docs, id_col, text_col, similarity, trees, recall)
    return (signed.select("_id", "_c").join(verdict.drop("td", "m", "wins"), "_c", "left")
            .withColumn("copy", F.coalesce("copy", "_id")).withColumn("class", F.coalesce("class", "copy"))
            .select(id_out(), id_out("copy_of", "copy"), id_out("class_id", "class"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float, trees: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """The rows with the digests of their words and text, and for each digest of words: the smallest id (copy) with the
    digest of its text (td) and the number of such rows (m), its class, links, and whether it stands for its class."""
    length = prefix_length(similarity, trees, recall=recall)
    signer = Signer(trees, length)
    rows = base(docs, id_col, text_col)
    signed = checkpointed(map_arrow(rows, _sign(signer), "_id long, _td string, n long, _c binary, nodes array<long>"))
    rows_of = (signed.where("_c is not null").groupBy("_c", "_id", "_td")
               .agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"), F.first("nodes").alias("nodes")))
    reps = checkpointed(rows_of.groupBy("_c").agg(F.min(F.struct("_id", "_td", "m", "n", "nodes")).alias("r"))
                        .select("_c", "r.*"))
    placed = reps.select("_c", "_id", "n", F.posexplode("nodes").alias("tree", "node"))
    crowded = (placed.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"), F.min("tree").alias("tree"),
                                          F.bit_xor(F.xxhash64("_c")).alias("f"), F.bit_xor(F.xxhash64("_c", F.lit(1))).alias("g"))
               .where("m > 1"))
    kept = (crowded.groupBy("m", "f", "g").agg(F.min(F.struct("tree", "node", "w")).alias("k"))
            .select("k.node", F.expr(f"greatest(1, ceil(m / {TILE_DOCS}), ceil(k.w / {TILE_SHINGLES}))").cast("int").alias("blocks")))
    asked = (placed.join(kept, "node")
             .groupBy("_id", "_c").agg(F.collect_list(F.struct(
                 "node", "tree", "blocks", F.pmod(F.xxhash64("_c", "node"), "blocks").cast("int").alias("block"))).alias("asked")))
    tiles = map_arrow(rows.join(asked, "_id").select("_id", "_text", "_c", "asked"), _deal(signer),
                      "tile string, tree int, side int, _c binary, nodes binary, shingles binary")
    links = checkpointed(map_arrow(tiles.repartition("tile").sortWithinPartitions("tile"), _verify(similarity),
                                   "_c binary, root binary, links long"))
    comp = connected_components(links.where("_c <> root").select(F.col("_c").alias("src"), F.col("root").alias("dst")).distinct())
    counts = links.groupBy("_c").agg(F.sum("links").alias("n_links"))
    known = (counts.join(comp.withColumnRenamed("node", "_c"), "_c").join(reps.select("_c", "_id"), "_c"))
    first = known.groupBy("comp").agg(F.min(F.struct("_id", "_c")).alias("first"))
    linked = known.join(first, "comp").select("_c", F.col("first._id").alias("class"), "n_links", (F.col("first._c") == F.col("_c")).alias("wins"))
    verdict = checkpointed(reps.select("_c", F.col("_id").alias("copy"), F.col("_td").alias("td"), "m").join(linked, "_c", "left")
                           .withColumn("wins", F.coalesce("wins", F.lit(True))))
    return signed, verdict


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs, all columns, of each class: one with its smallest id, also where rows repeat an id or have none. Rows
    without words all stay."""
    signed, verdict = _classes(docs, id_col, text_col, **({"similarity": SIMILARITY, "trees": TREES, "recall": RECALL} | options))
    keep = verdict.where("wins").select(F.col("copy").alias("_id"), F.col("td").alias("_td"), F.col("m").alias("_m"))
    blank = signed.where("_c is null").select("_id", "_td", F.lit(1).cast("long").alias("_m")).distinct()
    return kept_rows(docs, keep.unionByName(blank), id_col, digest(text_col))
