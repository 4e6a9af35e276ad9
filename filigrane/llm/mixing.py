"""Mixing sources to target weights, all in DataFrame functions: budgets go down a tree, leaves give seeded prefixes."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigrane.llm.common import checkpointed, digest

#: Rows of a leaf that one window of the running token count sorts.
CHUNK = 4096


def words(text: str = "text") -> Column:
    """Tokens of a text: its runs of non-blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill(nodes: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Share `_budget` of each parent among its children by `_weight`, none above its `_cap`: what a full child
    cannot take goes to its siblings in proportion. Adds `_alloc`.

    In the order of cap / weight the full children come first, so one running sum finds them."""
    w = Window.partitionBy(*parents).orderBy(F.expr("_cap / _weight"), F.col(name))
    big = "decimal(38,0)"
    n = (nodes.withColumn("_c", F.coalesce(F.sum("_cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(big))
         .withColumn("_w", F.sum("_weight").over(w.rowsBetween(0, Window.unboundedFollowing)).cast(big))
         .withColumn("_full", F.expr(f"cast(_cap as {big}) * _w <= (_budget - _c) * _weight")))
    every = Window.partitionBy(*parents)
    return (n.withColumn("_fc", F.coalesce(F.sum(F.expr("if(_full, _cap, 0)")).over(every), F.lit(0)))
            .withColumn("_ow", F.sum(F.expr("if(_full, 0L, _weight)")).over(every))
            .withColumn("_alloc", F.expr(f"if(_full, _cap, cast(cast(_budget - _fc as {big}) * _weight div _ow as long))"))
            .drop("_c", "_w", "_full", "_fc", "_ow"))


def mix(docs: DataFrame, levels: Sequence[tuple[str, Column]], weights: Sequence[Column], budget: Column | int,
        max_epochs: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that make up the mixture, with `_mix`: a struct of epoch, tokens, take and the
    levels (a column of that name in docs is replaced). A row appears once per epoch that takes it.

    levels: (name, expression of docs) from the root down; a null value is a child of its own, named ''. weights: per
    level a positive whole-number expression over the level names. budget: tokens to hand out, a number or an
    expression over `total` (all tokens). A leaf can give its tokens `max_epochs` times. A node gets at most what lies
    below it, so a shortage stays among siblings while they have anything left, and reaches the parent's siblings only
    then. Shares are rounded down to whole tokens.

    A leaf's epochs order its documents by md5 of seed, epoch and id. All epochs but the last are taken whole, the
    last up to its token budget; the document that crosses the budget is taken with `take` below `tokens`. The running
    count is over hash chunks, so that a leaf with a third of all rows is spread out; the texts are never shuffled.

    Null texts and texts without tokens cost nothing and come with every epoch of which their leaf takes any token
    before or at their place. Rows without an id are placed by their text. Rows that repeat an id follow each other in
    the order of their texts' md5; rows equal in id and text are taken or left together, and share equally what is left
    for them at the cut. Empty input, or a budget of 0, gives an empty result."""
    names = [n for n, _ in levels]
    own = {c: F.coalesce(e.cast("string"), F.lit("")).alias(f"_l_{c}") for c, e in levels}
    cols = [f"_l_{c}" for c in names]
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "_mix"]).alias("_row"), *own.values(), words(text_col).alias("_tok"),
                        F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), digest(text_col))).alias("_key"), digest(text_col).alias("_td"))
    slim = checkpointed(keyed.drop("_row"))
    leaf = slim.groupBy(*cols).agg(F.sum("_tok").alias("_size"), F.count(F.lit(1)).alias("_rows"))
    leaf = checkpointed(leaf.withColumn("_cap", F.col("_size") * max_epochs))
    every = Window.partitionBy()  # over the children of the root
    above = None
    for k, c in enumerate(cols):
        node = leaf.groupBy(*cols[:k + 1]).agg(F.sum("_cap").alias("_cap")) if k + 1 < len(cols) else leaf
        node = node.where("_cap > 0").select("*", *[F.col(x).alias(n) for x, n in zip(cols, names[:k + 1])])
        node = node.withColumn("_weight", weights[k].cast("long")).drop(*names[:k + 1])
        if k:
            node = node.join(above, cols[:k])
        else:
            node = (node.withColumn("total", F.expr(f"sum(_cap) over () div {int(max_epochs)}"))
                    .withColumn("_budget", F.least((budget if isinstance(budget, Column) else F.lit(budget)).cast("long"),
                                                   F.sum("_cap").over(every))).drop("total"))
        above = fill(node, cols[:k], c).drop("_budget", "_weight").withColumnRenamed("_alloc", "_budget").drop("_cap")
    plan = (above.withColumn("_whole", F.expr("_budget div _size")).withColumn("_rest", F.expr("_budget % _size"))
            .withColumn("_bits", F.ceil(F.log2(F.greatest(F.col("_rows") / CHUNK, F.lit(1)))).cast("int")))
    plan = checkpointed(plan)

    def place(epoch: Column) -> Column:
        return F.concat(F.md5(F.concat_ws("|", F.lit(seed), epoch, "_key")), F.col("_td"))

    part = (slim.join(plan.where("_rest > 0"), cols).withColumn("_place", place(F.col("_whole")))
            .withColumn("_chunk", F.expr("shiftright(cast(conv(substring(_place, 1, 8), 16, 10) as long), 32 - _bits)")))
    sums = part.groupBy(*cols, "_chunk").agg(F.sum("_tok").alias("_sum"), F.first("_rest").alias("_rest"))
    before = Window.partitionBy(*cols).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    cross = (sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
             .where("_before < _rest and _before + _sum >= _rest").select(*cols, "_chunk", "_before"))
    inner = Window.partitionBy(*cols, "_chunk").orderBy("_place")
    ends = (part.join(cross, [*cols, "_chunk"])
            .groupBy(*cols, "_chunk", "_place", "_before", "_rest").agg(F.sum("_tok").alias("_tok"), F.count(F.lit(1)).alias("_m"))
            .withColumn("_upto", F.col("_before") + F.sum("_tok").over(inner)).where("_upto - _tok < _rest and _upto >= _rest")
            .select(*cols, F.col("_place").alias("_last"), F.expr("(_rest - (_upto - _tok)) div _m").alias("_left")))
    cuts = checkpointed(plan.join(ends, cols, "left").select(*cols, "_whole", "_last", "_left"))
    taken = (keyed.join(cuts, cols)
             .withColumn("_place", place(F.col("_whole")))
             .withColumn("_n", F.expr("_whole + if(coalesce(_place <= _last, false), 1L, 0L)")).where("_n > 0")
             .withColumn("epoch", F.explode(F.expr("sequence(0L, _n - 1)"))))
    return taken.select("_row.*", F.struct(
        F.col("epoch"), F.col("_tok").alias("tokens"),
        F.expr("if(epoch = _whole and _place = _last, least(_left, _tok), _tok)").alias("take"),
        *[F.col(x).alias(n) for x, n in zip(cols, names)]).alias("_mix"))
