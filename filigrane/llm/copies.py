"""Exact dedup by skew-safe combining: local, salted, global."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane.llm.common import NO_ID, base, checkpointed, kept_rows

SALTS = 16
#: The blanks that count as one space.
BLANKS = r"[\x20\x09-\x0D]+"


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after every run of blanks became one space. The winner of a group is its
    smallest id. First every task combines its own rows (the partial step of the aggregate), then groups are merged by
    (digest, salt, content), so that a text that fills a third of the table is spread over `salts` reducers, then the
    salt winners are combined by (digest, content). Each step groups by the whole content, the digest only deals the
    rows out.

    Null and empty texts are equal. A null id stays only where a group has no other id. Rows that repeat an id within a
    group count in group_size and share its verdict. Empty input gives an empty result."""
    rows = base(docs, id_col, text_col).select(F.col("_id"), F.regexp_replace("_text", BLANKS, " ").alias("_t"))
    keyed = rows.select(F.nullif("_id", F.lit(-(2 ** 63))).alias("_i"), "_t", F.sha2("_t", 256).alias("_d"))
    salted = (keyed.withColumn("_s", F.pmod(F.xxhash64("_i"), F.lit(salts)))
              .groupBy("_d", "_s", "_t").agg(F.min("_i").alias("_k"), F.count(F.lit(1)).alias("_n")))
    winners = (salted.repartition("_d").groupBy("_d", "_t").agg(F.min("_k").alias("_k"), F.sum("_n").alias("_n")))
    verdict = (winners.groupBy("_d").agg(F.min("_k").alias("keep_id"), F.sum("_n").alias("group_size"),
                                         F.count(F.lit(1)).alias("_c"))
               .withColumn("keep_id", F.expr("if(_c > 1, raise_error('different texts share a SHA-256 digest'), keep_id)")))
    # A written table also lets the join split the rows of a digest that a third of the documents have.
    return (keyed.select("_i", "_d").join(checkpointed(verdict), "_d")
            .select(F.col("_i").alias("doc_id"), "keep_id", "group_size",
                    F.col("_i").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_d").alias("text_sha256")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row of docs, all columns, of each group of equal texts: one with the smallest id, also where rows repeat an id or
    have none."""
    keep = (exact_groups(docs, id_col, text_col, salts).where("kept").groupBy("doc_id", F.col("text_sha256").alias("_td"))
            .agg(F.count(F.lit(1)).alias("_m")).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), "_td", "_m"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return kept_rows(docs, keep, id_col, F.sha2(F.regexp_replace(text, BLANKS, " "), 256))

