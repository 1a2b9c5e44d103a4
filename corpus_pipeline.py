"""The corpus pipeline: documents pass through the stages below, each written as
Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm import decontaminate, exact_dedup, jaccard_join, langid, mixing
from textquarry.llm.common import materialize, read


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those of ``und`` go."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones: the longest text stays."""
    return jaccard_join.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no question or answer of the benchmark."""
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The order of showing: one row per showing of a document, every one shown at least once."""
    return mixing.mix(docs, max_epochs=mixing.MAX_EPOCHS)


STAGES = [("language_id", language), ("exact_dedup", exact), ("jaccard_join", near), ("decontaminate", clean), ("mixing", mixed)]

#: Learned language statistics and a similarity join are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
