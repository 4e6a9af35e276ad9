"""K-d tree sharding: split at weighted medians along the widest metadata dimension until leaves have the target size."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigrane.llm.common import checkpointed, digest

#: Coordinates lie in 0 .. SIDE - 1; ties along a dimension are ordered by a 32-bit hash of the id.
SIDE = 1 << 20
BUCKETS = 4096
#: Rows that one window numbers.
CHUNK = 4096


def hashed(value: Column) -> Column:
    """Coordinate of a category; null is a category."""
    return F.shiftright(F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 12)


def magnitude(value: Column) -> Column:
    """Coordinate of a count: its number of binary digits."""
    return F.length(F.bin(F.greatest(F.coalesce(value, F.lit(0)), F.lit(0)))).cast("long") * (SIDE // 64)


def _values(spark, rows: list[tuple], names: Sequence[str]) -> DataFrame:
    """A small inline table; the tree has one node per split."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join("(" + ", ".join(f"{v}L" for v in r) + ")" for r in rows)
                     + f" AS t({', '.join(names)})")


def _cuts(points: DataFrame, nodes: dict[int, int], dims: Sequence[str]) -> list[tuple[int, int, int]]:
    """(node, dimension, key) of each node: its rows with a smaller key go left. The left side gets the longest run of
    keys whose weight is at most its part of the node's. Rounds of histograms with BUCKETS buckets per node close in on
    the key; only histogram rows meet in a window, and one row per node comes to the driver."""
    spark = points.sparkSession
    spans = points.groupBy("_node").agg(F.sum("_size").alias("total"), *[
        f(d).alias(f"{d}_{n}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).collect()
    found, open_ = [], []
    for r in spans:
        k = nodes[r["_node"]]
        wide = max(range(len(dims)), key=lambda j: (r[f"{dims[j]}_hi"] - r[f"{dims[j]}_lo"], -j))
        lo, hi = r[f"{dims[wide]}_lo"] << 32, (r[f"{dims[wide]}_hi"] << 32) + (1 << 32) - 1
        open_.append((r["_node"], wide, r["total"] * (k // 2) // k, 0, lo, hi))
    while open_:
        state = _values(spark, open_, ["_node", "wide", "want", "before", "lo", "hi"])
        key = F.element_at(F.array(*dims), F.expr("cast(wide + 1 as int)")) * (1 << 32) + F.col("_tie")
        step = F.expr(f"(hi - lo) div {BUCKETS} + 1")
        hist = (points.join(F.broadcast(state), "_node").withColumn("key", key).where("key between lo and hi")
                .withColumn("bucket", F.expr("key - lo") / step)
                .withColumn("bucket", F.col("bucket").cast("long"))
                .groupBy("_node", "wide", "want", "before", "bucket")
                .agg(F.sum("_size").alias("size"), F.min("key").alias("lo"), F.max("key").alias("hi")))
        upto = F.sum("size").over(Window.partitionBy("_node").orderBy("bucket"))
        over = hist.withColumn("upto", F.col("before") + upto).where("upto > want")
        rows = over.groupBy("_node", "wide", "want").agg(F.min_by(F.struct(
            F.expr("upto - size").alias("before"), "lo", "hi"), "bucket").alias("b")).collect()
        found += [(r["_node"], r["wide"], r["b"]["lo"]) for r in rows if r["b"]["lo"] == r["b"]["hi"]]
        open_ = [(r["_node"], r["wide"], r["want"], r["b"]["before"], r["b"]["lo"], r["b"]["hi"])
                 for r in rows if r["b"]["lo"] != r["b"]["hi"]]
    return found


def assign(points: DataFrame, dims: Sequence[str], shards: int) -> DataFrame:
    """Add `shard` (0 .. shards - 1) to a table of _size, _tie and the dimensions. A node with k leaves to come gives
    floor(k / 2) of them, and that part of its bytes, to its left side."""
    spark = points.sparkSession
    # all rows start in node 0; an expression of a column, as a constant would turn the joins by node into nested loops
    out, nodes = points.withColumn("_node", F.col("_tie") - F.col("_tie")), {0: shards}
    while any(k > 1 for k in nodes.values()):
        split = {n: k for n, k in nodes.items() if k > 1}
        alive = out.where(F.col("_node").isin(*split)) if len(split) < len(nodes) else out
        cuts = [(n, d, c, split[n] // 2) for n, d, c in _cuts(alive, split, dims)]
        if not cuts:  # no rows at all
            break
        tree = F.broadcast(_values(spark, cuts, ["_node", "_wide", "_cut", "_right"]))
        key = F.element_at(F.array(*dims), F.expr("cast(_wide + 1 as int)")) * (1 << 32) + F.col("_tie")
        out = (out.join(tree, "_node", "left")
               .withColumn("_node", F.when(key >= F.col("_cut"), F.expr("_node + _right")).otherwise(F.col("_node")))
               .drop("_wide", "_cut", "_right"))
        nodes = {m: c for n, k in nodes.items() for m, c in (((n, k // 2), (n + k // 2, k - k // 2)) if k > 1 else ((n, k),))}
    return out.withColumn("shard", F.col("_node").cast("int")).drop("_node")


def slots(placed: DataFrame, rows: int, shards: int) -> DataFrame:
    """Add `slot`, gapless from 0 in each shard, in the order of _tie, _id, _crc. Numbered inside hash chunks; one row
    per chunk carries the count over."""
    bits = max(0, (rows // max(1, shards) // CHUNK).bit_length())
    p = placed.withColumn("_chunk", F.shiftright("_tie", 32 - bits))
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (p.groupBy("shard", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    at = F.row_number().over(Window.partitionBy("shard", "_chunk").orderBy("_tie", "_id", "_crc"))
    return p.withColumn("_at", at).join(starts, ["shard", "_chunk"]).withColumn("slot", F.col("_start") + F.col("_at") - 1)


def shard(docs: DataFrame, dims: Sequence[tuple[str, Column]], shards: int | None = None,
          target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32, shard, slot: one row per row of docs, shards of nearly equal bytes.

    dims: (name, coordinate) with coordinates in 0 .. SIDE - 1, see `hashed` and `magnitude`. The number of leaves is
    given, or follows from the bytes and `target_bytes`. Each node is split along the dimension with the widest range
    of coordinates, at the exact weighted quantile, so sizes differ by no more than the rows at the cuts. Neither texts
    nor rows move for that: every level reads a slim table of coordinates and sends histograms.

    A null text has no bytes, its crc is 0; a row without an id is placed by the md5 of its text. Rows that repeat an id share all coordinates
    where their metadata is equal and then lie in one shard. Empty input gives an empty result; with fewer rows than
    shards some shards stay empty."""
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    names = [f"_d{k}" for k in range(len(dims))]
    slim = checkpointed(docs.select(
        F.col(id_col).cast("long").alias("_id"), (F.octet_length(body) + 8).cast("long").alias("_size"), F.crc32(body).alias("_crc"),
        F.crc32(F.coalesce(F.col(id_col).cast("string"), digest(text_col)).cast("binary")).alias("_tie"),
        *[e.cast("long").alias(n) for n, (_, e) in zip(names, dims)]))
    rows, size = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    leaves = shards or max(1, -(-size // target_bytes))
    placed = checkpointed(assign(slim, names, leaves))
    return slots(placed, rows, leaves).select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", "slot")


