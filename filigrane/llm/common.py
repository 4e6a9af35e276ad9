"""Helpers the corpus operators share: tidy inputs, Arrow streams, scratch tables.

All operators treat their input alike. Only the named columns are read, under internal names, so extra columns of any
name cannot clash. A null text counts as an empty one. A null id is a document of its own that sorts before all
others; inside the operators it is NO_ID, in results it is null again.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.session import checkpointed, shared_folder

__all__ = ["NO_ID", "base", "blocks", "checkpointed", "digest", "groups", "id_out", "kept_rows", "map_arrow", "release", "scratch"]

NO_ID = -(2 ** 63)

#: UTF-8 bytes of text that one vectorised step handles at once; a longer text is a block of its own. The step holds some twenty times
#: as much in arrays, in every Python worker of an executor; larger blocks are no faster.
BLOCK_BYTES = 1_000_000


def base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id (long, never null) and _text (never null)."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def id_out(name: str = "doc_id", column: str = "_id") -> Column:
    return F.nullif(F.col(column), F.lit(NO_ID)).alias(name)


def digest(text_col: str = "text") -> Column:
    """What tells rows of one id, or without an id, apart."""
    return F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def kept_rows(docs: DataFrame, keep: DataFrame, id_col: str, key: Column) -> DataFrame:
    """The rows of docs, all columns, whose id and key stand in `keep` (_id, _td, _m, each pair once). Where _m rows are
    equal in both and _m is above 1, one of them stays."""
    keep = checkpointed(keep)
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), key.alias("_td"))
    if keep.where("_m > 1").isEmpty():
        return rows.join(keep, ["_id", "_td"], "left_semi").select("_row.*")
    found = rows.join(keep, ["_id", "_td"])
    one = found.where("_m > 1").groupBy("_id", "_td").agg(F.first("_row").alias("_row"))  # combined in each task first
    return found.where("_m = 1").select("_row.*").unionByName(one.select("_row.*"))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """mapInArrow for functions that yield plain {column: values}; columns get the types of the schema."""
    names = [f.split()[0] for f in _fields(schema)]

    def run(batches):
        want = None
        for out in fn(batches):
            if want is None:
                want = [_arrow(f.split(None, 1)[1]) for f in _fields(schema)]
            yield pa.RecordBatch.from_arrays([_array(out[n], t) for n, t in zip(names, want)], names=names)
    return df.mapInArrow(run, schema)


def _fields(schema: str) -> list[str]:
    """Column definitions of a DDL string; commas inside <> do not separate."""
    parts, depth, last = [], 0, 0
    for k, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            parts.append(schema[last:k].strip())
            last = k + 1
    return [*parts, schema[last:].strip()]


def _arrow(kind: str) -> pa.DataType:
    kind = kind.strip()
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    if kind.startswith("struct<"):
        return pa.struct([pa.field(*(lambda a: (a[0].strip(), _arrow(a[1])))(f.split(":", 1))) for f in _fields(kind[7:-1])])
    return {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
            "binary": pa.binary(), "boolean": pa.bool_()}[kind]


def _array(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, type=kind)


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[list, list]]:
    """(ids, texts) lists of at most `limit` characters of text, at least one row each."""
    for b in batches:
        ids, texts, n = [], [], 0
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            t = t.as_py()
            if ids and n + len(t) > limit:
                yield ids, texts
                ids, texts, n = [], [], 0
            ids.append(i)
            texts.append(t)
            n += len(t)
        if ids:
            yield ids, texts


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal `key` from a stream sorted by it; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        keys = b.column(b.schema.get_field_index(key)).to_pylist()
        start = 0
        for k in range(len(keys) + 1):
            if k == len(keys) or keys[k] != last:
                if k > start:
                    held.append(b.slice(start, k - start))
                if k < len(keys):
                    if held:
                        yield pa.Table.from_batches(held)
                    held, last, start = [], keys[k], k
    if held:
        yield pa.Table.from_batches(held)


def scratch(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """A table written to the shared folder, and a function that deletes it when nothing will read it any more."""
    kept = checkpointed(df)
    path = kept.inputFiles()[0].rsplit("/", 1)[0] if kept.inputFiles() else None
    return kept, lambda: path and release(df.sparkSession, path)


def release(spark: SparkSession, path: str) -> None:
    if shared_folder(spark).removeprefix("file://").rstrip("/") not in path:
        raise ValueError(f"{path} is no scratch table")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
