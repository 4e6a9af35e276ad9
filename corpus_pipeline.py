"""A training corpus from documents: five stages of the corpus operators, each on all that the one before it kept.

Every stage but the last returns the columns of documents. A driver of the stages writes each result as Parquet and
reads it again; `run` does so in the shared folder.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.llm import decontaminate, forest, language
from filigrane.llm.catalog import held_out, mixture, sharding
from filigrane.llm.common import checkpointed

#: A document whose language is less certain than this goes, as one without any letter does.
MIN_SCORE = 0.2


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language the model knows. It learns from the labelled documents that are not held out."""
    model = language.learn(docs.where(~held_out(docs)))
    return language.keep_known(docs, model, MIN_SCORE) if model else docs.where(F.col("text").rlike(r"\p{L}"))  # nothing to tell languages by


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return forest.distinct_documents(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Three quarters as many tokens as there are, shared out by the target weights; a second epoch repeats rows."""
    return mixture(docs, F.expr("total * 3 div 4")).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mixture with its shard and its place there."""
    return sharding(docs)


STAGES = [("language", by_language), ("near_copies", without_near_copies), ("decontamination", decontaminated),
          ("mixing", mixed), ("sharding", sharded)]

#: Trained models, signatures and BM25 cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return docs
