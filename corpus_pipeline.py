"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtrail.llm import language, line_dedup, mixing, near_documents, packing
from labtrail.llm.common import DOCUMENT_COLUMNS, materialize
from labtrail.llm.queries import TARGET_WEIGHTS


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected (no letters, or a score under the calibrated threshold) go.

    A document without a language gets the one predicted.
    """
    found = language.predict(docs, language.train(docs)).where("not rejected")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(DOCUMENT_COLUMNS)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages go that stand in an earlier document; a document of which nothing is left goes with them."""
    found = line_dedup.dedup_lines(docs).where("removed_chunks = 0 or trim(text) != ''")
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(DOCUMENT_COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    return near_documents.keep_one(docs).select(DOCUMENT_COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target weights, and shuffled."""
    return mixing.mix(docs, TARGET_WEIGHTS).select(DOCUMENT_COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("language id", identified),
    ("line dedup", without_repeated_passages),
    ("near dedup", without_near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL has neither the training of the first stage nor the tokenizer of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
