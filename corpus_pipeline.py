"""From raw documents to packed training sequences: five stages, each over all that the one before it kept.

Every stage reads whole texts, however long, takes extra columns of any name along (the
last returns its pieces alone), and gives an empty table for an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palaver.llm import exact_dedup, minhash, packing, pii, quality
from palaver.llm.tables import stash, table

#: Near-duplicates share at least 0.8 of their runs of five words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rules, weighed by their estimated accuracies, reject.  Null and empty texts go; of repeated rows all stay or none."""
    return quality.keep_good(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of the documents that are equal but for white space, the longest, then that of the smallest doc_id.  Null and empty texts are equal; of repeated rows one stays; a row with a repeated or null doc_id leaves for its own text alone."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of the smallest doc_id.  Texts without words all stay; of repeated rows one stays; a row with a repeated or null doc_id leaves for its own text alone."""
    return minhash.drop_near_duplicates(docs, NEAR_WORDS, NEAR_PERCENT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind and restates their lengths.  Nulls stay null, and every row stays."""
    return pii.redact_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of tokens; a row is a piece.  A null or empty text has the end id alone; repeated rows are packed each."""
    return packing.pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("sequences", sequences),
]

#: Expectation-maximisation, the random field and the tokenizer have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
