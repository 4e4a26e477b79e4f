"""The corpus pipeline: quality rules, quality classifier, near copies, personal data, packing.

Each stage reads what the one before wrote and returns documents with the columns they came with; the last returns one
row per packed piece. Stages take (spark, docs, sf_dir). All rows that a stage receives are judged; rejected documents
and all but one of each group of near copies go, personal data is replaced in the text that stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.common import stored, table
from tickloom.llm.ngram_join import without_near_copies
from tickloom.llm.packing import packed
from tickloom.llm.pii import redacted
from tickloom.llm.quality_classifier import fit, quality_accepted, train_labels
from tickloom.llm.quality_rules import quality_kept
from tickloom.llm.queries import WORD_BPE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the limits on repeated substrings."""
    return quality_kept(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold of a model fitted to the labelled documents still here.

    Labels of documents held out from training are not read.
    """
    return quality_accepted(docs, fit(docs, train_labels(table(spark, sf_dir, "labels"))))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard likeness of at least 0.8 over shingles of five words."""
    return without_near_copies(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    return packed(docs, WORD_BPE)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("packing", packing),
]

# A model fitted by gradient updates decides in the second stage: SQL cannot state it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
