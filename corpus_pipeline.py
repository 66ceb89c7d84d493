"""Corpus pipeline: quality, near duplicates, benchmark decontamination, mixture, shards.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir), where docs is what the stage
before has kept, and returns the documents that go on, with their own columns; the mixture
returns a document as often as it takes it, and the last stage adds its shard and slot.
``run`` writes every stage's result as Parquet below the shared folder and reads it back as the
next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.decontaminate import decontaminated
from sluice.llm.jaccard import one_of_each_group
from sluice.llm.mixing import copied, pareto_mix, word_count
from sluice.llm.quality import acceptable
from sluice.llm.queries import MIX_SEED, SHARD_SEED, SHARDS, table
from sluice.llm.sharding import interleaved_shards
from sluice.session import persist_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier finds acceptable."""
    return acceptable(spark, docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is connected by five-word Jaccard similarities of 0.8 or more."""
    return one_of_each_group(spark, docs, k=5, num=8, den=10)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not repeat benchmark passages."""
    return decontaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    mixed = pareto_mix(spark, docs, F.col("source"), F.col("doc_id"), word_count(F.col("text")), MIX_SEED)
    return copied(mixed, docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in shards that each have its proportions."""
    return interleaved_shards(spark, docs, SHARDS, F.col("source"), F.col("doc_id"), SHARD_SEED)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixture", mixture), ("shards", shards)]

# the classifier is fitted, which SQL cannot express; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = persist_table(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
