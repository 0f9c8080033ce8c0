"""A corpus run: each stage takes the documents that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellpulse.llm import langid, minhash, mixing, packing, quality
from cellpulse.llm.common import landed, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose languages were recognised, however many they are."""
    return langid.with_known_language(docs)


def keep_good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, calls good."""
    return quality.good_texts(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return minhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in windows."""
    return packing.packed(docs)


STAGES = [
    ("keep_known_languages", keep_known_languages),
    ("keep_good_texts", keep_good_texts),
    ("keep_one_of_each_class", keep_one_of_each_class),
    ("mix_sources", mix_sources),
    ("pack_windows", pack_windows),
]
# The stages learn and search, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
