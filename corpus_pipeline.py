"""A corpus pipeline: language, exact copies, near copies, repeated passages, packed sequences.

Every stage takes all that the stage before kept, as Parquet, and all but the last return the
columns of ``documents``.  No SQL expresses the stages' kernels, fingerprints and tokens, so the
result is tested against a brute-force version (``tests/llm``).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.llm.common import staged, table
from scenelake.llm.exact_dedup import without_duplicates
from scenelake.llm.language_id import UNKNOWN, identify, learn
from scenelake.llm.packing import pack
from scenelake.llm.simhash import without_near_duplicates
from scenelake.llm.substring_dedup import without_repeats

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; null texts and texts without letters go."""
    found = identify(docs, learn(docs))
    return found.where(F.col("lang_pred") != UNKNOWN).select(*(F.col(f"`{c}`") for c in docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside."""
    return without_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest, of each component of near-equal fingerprints."""
    return without_near_duplicates(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that smaller ones have; lengths follow the texts."""
    kept = without_repeats(docs)
    if "n_chars" not in kept.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens, with their ids."""
    found = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        "ids",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        F.col("sequence").alias("sequence_id"),
        "offset",
    )


STAGES = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("passages", passages),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"kept-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
