"""The corpus pipeline: quality rules, near-duplicates, benchmark items,
mixing, sharding. Each stage takes (spark, docs, sf_dir) and works on all that
the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callwatch.llm import decontamination, mixing, near_dedup, quality_rules, sharding
from callwatch.runtime import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its shard."""
    return sharding.assign_shards(docs)


STAGES = [("quality rules", quality), ("near-duplicates", dedup), ("benchmark decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: SQL has no sketches, SimHash or sampling keys of this kind; the stages are
#: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read
    again for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
