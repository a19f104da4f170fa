"""The operators applied to their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import classify, ivfpq, language_model, lattice, mixing, packing, sharding, simhash, tokens
from lodestone.llm.common import table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.kd_shards(table(spark, sf_dir, "documents"), shards=16)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_scores(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(table(spark, sf_dir, "documents"))
    value = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return drawn.select("doc_id", value("source"), value("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), F.round("mix_weight", 6).alias("weight"), F.round("mix_chance", 6).alias("chance"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), window=4096, end=2)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_sharding, op4_language_scores, op5_mixing, op6_simhash, op7_packing, op8_embedding_near_dedup, op9_nearest_neighbours, op10_quality)
}
ORACLE_SQL: dict[str, str] = {"op5_mixing": mixing.oracle()}
