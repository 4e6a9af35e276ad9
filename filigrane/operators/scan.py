"""Ordered computations over long groups without putting a group into one task.

A group (one edge, one burst) may hold a large share of all rows, so nothing here runs a window over a whole
group of rows. Groups are cut into chunks of consecutive positions; windows run inside a chunk, and one row per
chunk carries the state over chunk borders.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from filigrane.session import checkpointed

CHUNK = 4096


def _agg(kind: str, e: Column) -> Column:
    return {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}[kind](e)


def running(df: DataFrame, keys, order, chunk: str, specs: dict, exclusive=(), cut: bool = False) -> DataFrame:
    """Add running values in `order` within `keys`: {name: (kind, expression)} from the start, {name: (kind,
    expression, "back")} from the end; kind is sum, max, min or last (the latest non-null). `chunk` is a column that
    never decreases along the order. Names in `exclusive` leave the row itself out.

    The rows are read twice (once for the chunk totals); `cut` checkpoints them first, which chained scans need so
    that the work does not double with every step."""
    keys = list(keys)
    if cut:
        df = checkpointed(df)
    exprs = {}
    for n, spec in specs.items():
        exprs[n] = (spec[0], F.expr(spec[1]) if isinstance(spec[1], str) else spec[1], len(spec) > 2)
    fwd, back = [F.col(c).asc() for c in order], [F.col(c).desc() for c in order]

    def frame(n, rev):
        w = Window.partitionBy(*keys, chunk).orderBy(*(back if rev else fwd))
        return w.rowsBetween(Window.unboundedPreceding, -1 if n in exclusive else 0)

    totals, carries = [], []
    for n, (k, e, rev) in exprs.items():
        if k == "last":
            pick = F.min_by if rev else F.max_by
            totals.append(pick(e, F.when(e.isNotNull(), F.struct(*order))).alias(f"_t_{n}"))
        else:
            totals.append(_agg(k, e).alias(f"_t_{n}"))
        before = (Window.partitionBy(*keys).orderBy(F.col(chunk).desc() if rev else F.col(chunk).asc())
                  .rowsBetween(Window.unboundedPreceding, -1))
        carries.append(_agg(k, F.col(f"_t_{n}")).over(before).alias(f"_c_{n}"))
    carry = df.groupBy(*keys, chunk).agg(*totals).select(*keys, chunk, *carries)
    out = df.select("*", *[_agg(k, e).over(frame(n, rev)).alias(f"_i_{n}") for n, (k, e, rev) in exprs.items()])
    # the rows of a chunk are in one task already; where chunks are short, there are nearly as many carries as rows: no broadcast
    out = out.join(carry.hint("merge"), keys + [chunk], "left")
    for n, (k, _, _) in exprs.items():
        i, c = F.col(f"_i_{n}"), F.col(f"_c_{n}")
        v = {"sum": F.when(i.isNull() & c.isNull(), None).otherwise(F.coalesce(i, F.lit(0)) + F.coalesce(c, F.lit(0))),
             "max": F.greatest(i, c), "min": F.least(i, c), "last": F.coalesce(i, c)}[k]
        out = out.withColumn(n, v)
    return out.drop(*[f"_i_{n}" for n in exprs], *[f"_c_{n}" for n in exprs])


def halo(df: DataFrame, reach: int, pos: str = "i", chunk: int = CHUNK) -> DataFrame:
    """Copy every row into its chunk `_c` and, near a border, into the next one, so that a frame of up to `reach`
    positions around a row lies in one chunk. `_own` marks the original; keep only those after the windows over
    (keys, _c). For row frames the positions have to be dense."""
    if reach > chunk:
        raise ValueError("reach must not exceed the chunk")
    c = F.expr(f"cast(floor(({pos}) / {chunk}) as long)")
    off = F.expr(f"({pos}) - {chunk} * floor(({pos}) / {chunk})")
    copies = F.array_compact(F.array(c, F.when(off <= reach, c - 1), F.when(off >= chunk - reach, c + 1)))
    return df.withColumn("_c", F.explode(copies)).withColumn("_own", F.col("_c") == c)


def own(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_c")


def even_chunks(df: DataFrame, position: str, name: str = "_chunk", rows: int = CHUNK) -> DataFrame:
    """A chunk number from a numeric position column: about `rows` rows per chunk over the whole table when the
    positions are spread evenly. Reads one row of bounds."""
    lo, hi, n = df.agg(F.min(F.expr(position)), F.max(F.expr(position)), F.count(F.lit(1))).first()
    width = max(1, int((hi - lo + 1) // max(1, -(-n // rows)))) if n else 1
    return df.withColumn(name, F.expr(f"(({position}) - {lo or 0}) div {width}"))


def spread(df: DataFrame, rows: int) -> DataFrame:
    """The rows dealt out evenly, about `rows` to a task however many there are, before each of them is copied many times. Reads
    the row count, so df is a stored table."""
    return df.repartition(max(1, -(-df.count() // rows)))


def _batch_counts(batches):
    for b in batches:
        t = pa.Table.from_batches([b])
        if not t.num_rows:
            continue
        if any(pa.types.is_nested(f.type) for f in t.schema):  # Arrow does not group by these
            yield b.from_arrays([*b.columns, pa.array(np.ones(len(b), np.int64))], [*t.column_names, "_w"])
        else:
            c = t.group_by(t.column_names, use_threads=False).aggregate([([], "count_all")])
            yield from c.select([*t.column_names, "count_all"]).rename_columns([*t.column_names, "_w"]).combine_chunks().to_batches()


#: Rows of a task that groups rows nearly all of which differ.
PART = 1 << 18


def parts(df: DataFrame) -> int:
    """Parts for an ordered or grouped copy of a stored table: of at most PART rows, and enough for all cores where each has some work."""
    n = df.count()
    return max(1, -(-n // PART), min(df.sparkSession.sparkContext.defaultParallelism, -(-n // (PART >> 4))))


def batch_counted(df: DataFrame) -> DataFrame:
    """The rows with `_w`, how often each stands in its batch: a row per batch and distinct row, without a shuffle."""
    return df.mapInArrow(_batch_counts, StructType([*df.schema.fields, StructField("_w", LongType())]))


def counted(df: DataFrame, rows: int) -> DataFrame:
    """Distinct rows with their count `_w`; `rows` is about how many there are, and sets the number of parts. Where nearly all rows differ, a grouping before the shuffle shrinks nothing and holds all
    rows of a task; here equal rows meet batch by batch before it, so that frequent ones are few, and all of them after it."""
    return batch_counted(df).repartition(max(1, -(-rows // PART)), *df.columns).groupBy(*df.columns).agg(F.sum("_w").alias("_w"))


def at_positions(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """A join on single positions of edges, both sides shuffled. The planner goes by the size of files, of which encoded positions take
    a small part of their rows, and does not count rows that lists of positions become: it would broadcast them."""
    return left.join(right.hint("merge"), list(keys), how)


def islands(df: DataFrame, keys, flag: str, pos: str = "i", chunk: int = CHUNK) -> DataFrame:
    """Maximal stretches of true `flag`: keys, run_start, run_end, n."""
    return (_stretch(df, keys, flag, pos, chunk).where(flag)
            .groupBy(*keys, "_gap").agg(F.min(pos).alias("run_start"), F.max(pos).alias("run_end"),
                                        F.count(F.lit(1)).alias("n")).drop("_gap"))


def _stretch(df: DataFrame, keys, flag: str, pos: str = "i", chunk: int = CHUNK) -> DataFrame:
    d = df.withColumn("_ck", F.expr(f"{pos} div {chunk}"))
    d = running(d, keys, [pos], "_ck", {"_gap": ("max", f"case when not {flag} then {pos} end")}).drop("_ck")
    return d.withColumn("_gap", F.coalesce("_gap", F.lit(-1)))


def groups_by_break(df: DataFrame, keys, order, chunk: str, prev: dict, brk: str, name: str = "_run") -> DataFrame:
    """Number the groups of consecutive rows: `prev` holds running values over the rows before ({name: (kind,
    expression)}), and `brk` is true where a row starts a new group."""
    d = running(df, keys, order, chunk, prev, exclusive=tuple(prev))
    d = d.withColumn("_brk", F.expr(f"cast(coalesce({brk}, true) as long)"))
    return running(d, keys, order, chunk, {name: ("sum", "_brk")}, cut=True).drop("_brk")


with_stretch = _stretch
