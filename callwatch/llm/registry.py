"""The numbered queries, the pipeline and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwatch.llm import conversation_repair, decontamination, mixing, near_dedup, pii, quality_classifier, quality_rules, sharding, spelling, substring_dedup, token_counts, token_files, vector_search
from callwatch.llm.oracles import ORACLES
from callwatch.runtime import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_documents(spark, sf_dir))
    return judged.withColumns({c: F.round(c, 6) for c in ("character_distance", "word_distance")})


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_documents(spark, sf_dir)).drop("copies")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_documents(spark, sf_dir), TOKENIZER)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), width=2)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(_documents(spark, sf_dir))
    return placed.select("doc_id", "slot", "shard")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), TOKENIZER)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_documents(spark, sf_dir))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired_conversations(table(spark, sf_dir, "conversations"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_substring_dedup, op3_decontamination, op4_mixing, op5_token_files, op6_near_dedup, op7_quality_classifier, op8_sharding, op9_token_counts, op10_pii, op11_spelling_variants, op12_conversation_repair, op13_nearest_neighbours, pipeline)}


def oracles() -> dict[str, str]:
    return dict(ORACLES)
