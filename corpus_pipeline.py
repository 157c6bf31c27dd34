"""A training-data pipeline: language ID, near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents,
whatever further columns these have and whatever their names.

Defined results. Language ID: a text that is null, empty or has no letter goes; one in
several languages stays. Near-dedup: of each group the document with the smallest doc_id
stays, a null one before all others, ties by a hash of the text; of rows with equal doc_id
and text one stays; documents without words stay. Suffix-array dedup: all rows stay, later
copies of 100-byte strings go, n_chars follows. Packing: each document, also an emptied one,
ends with the end id. Very long texts need memory for one or two of them at a time. An empty
table gives empty results in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deductra.llm import langid, minhash, packing, suffix_dedup
from deductra.llm._spark import cut


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language (op 7)."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (op 10; five words, 0.8)."""
    return minhash.keep_one(docs)


def exact_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated 100-byte strings (op 5)."""
    return suffix_dedup.kept_text(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left in sequences of 4,096 tokens (op 9)."""
    return packing.pack(docs)


STAGES = [("language ID", language), ("near dedup", near_dedup), ("suffix-array dedup", exact_substrings), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
