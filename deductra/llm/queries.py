"""The corpus operators' queries, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, langid, media, minhash, oracles, packing, sharding, spotsigs, substring_dedup, suffix_dedup


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SpotSigs fingerprints of every text and of its edited form."""
    return spotsigs.fingerprints(_documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE ids of every text by prefix dynamic programming, and their decoding."""
    return bpe.digests(_documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 of nearly equal size, equal texts together."""
    return sharding.shard(_documents(spark, sf_dir))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.digests(rows.unionByName(more))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings, removed but for their first place."""
    return suffix_dedup.removed(_documents(spark, sf_dir))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an image in tar shards and read back."""
    return media.features(_documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from three quarters of the labelled rows."""
    return langid.identify(_documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in repeated windows of 35 words, removed everywhere."""
    return substring_dedup.removed(_documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids packed into sequences of 4,096."""
    return packing.pack(_documents(spark, sf_dir))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by 4-word shingle sets with a similarity of 0.8."""
    return minhash.near_duplicates(_documents(spark, sf_dir), words=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = op1_spotsigs, op2_bpe, op3_sharding, op4_chat, op5_suffix_array_dedup, op6_media, op7_language_id, op8_substring_dedup, op9_packing, op10_minhash
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The queries that DuckDB can judge; the others rest on codecs, tokenizers, models and hashes that it lacks."""
    return {name: " ".join(sql.split()) for name, sql in oracles.SQL.items()}
