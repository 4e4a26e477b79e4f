"""The queries of this subpackage: one per operator, over whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .filter_audit import filter_audit, oracle as audit_oracle
from .fingerprints import edited_fingerprints
from .lexical_search import lexical_search, oracle as search_oracle
from .licences import licence_scan, oracle as licence_oracle
from .lm_scoring import fit_language, lm_scores
from .ngram_join import near_copies, oracle as near_copies_oracle
from .packing import packed
from .pieces import round_trip
from .pii import digest, personal_data
from .quality_classifier import fit, quality_scores, train_labels
from .quality_rules import oracle as quality_oracle, quality_report
from .simhash import simhash_groups
from .token_counts import masking_edits, recounted, token_trees

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"), WORD_BPE)


def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return edited_fingerprints(table(spark, folder, "documents"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each text before and after its masking edits, and how many characters were encoded for the second count."""
    docs = table(spark, folder, "documents")
    docs = docs.select("doc_id", "text", masking_edits(docs["text"], docs["source"]).alias("edits"))
    found = recounted(token_trees(docs, WORD_BPE, more=["edits"]), WORD_BPE)
    return found.select("doc_id", "n_tokens", "edited_tokens", "encoded_chars", F.length("text").cast("long").alias("edited_chars"))


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return digest(personal_data(table(spark, folder, "documents")))


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(table(spark, folder, "documents"), words=3, percent=90)


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_scores(docs, fit(docs, train_labels(table(spark, folder, "labels"))))


def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return lm_scores(docs, fit_language(docs))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_report(table(spark, folder, "documents"))


def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Number and CRC-32 of each text's piece ids, and the SHA-256 of what they decode to."""
    return round_trip(table(spark, folder, "documents"), PIECES)


def op10_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licence_scan(table(spark, folder, "documents"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=20)


def op13_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_groups(table(spark, folder, "documents"), words=3, distance=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_fingerprints": op2_fingerprints,
    "op3_token_counts": op3_token_counts,
    "op4_pii": op4_pii,
    "op5_ngram_join": op5_ngram_join,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_quality_rules": op8_quality_rules,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_licences": op10_licences,
    "op11_filter_audit": op11_filter_audit,
    "op12_lexical_search": op12_lexical_search,
    "op13_simhash": op13_simhash,
}
# Each maps a query to DuckDB's SQL for the same rows.
ORACLES: dict[str, str] = {
    "op5_ngram_join": near_copies_oracle(3, 90), "op8_quality_rules": quality_oracle(), "op10_licences": licence_oracle(),
    "op11_filter_audit": audit_oracle(), "op12_lexical_search": search_oracle(20),
}
