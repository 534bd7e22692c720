"""The corpus pipeline: language identification, quality rules, near-duplicates, secret scans and packing, in this order.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes every stage's result to the shared folder and reads it again as the next
one's documents, so that a lost executor costs no more than the stage in hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamella.llm import common, language_id, near_dedup, packing, quality_rules, secret_scan, tokens


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told go on."""
    return language_id.keep(docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy go on."""
    return quality_rules.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group goes on."""
    return near_dedup.keep(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document goes on, with the secrets in its text replaced."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document, a row for each sequence."""
    return packing.digest(packing.pack(docs, tokens.public("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Learned models, signatures and tokenizers are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with common.scope() as keep:
            after = keep(common.stored(stage(spark, docs, sf_dir), name))
        common.free(docs)
        docs = after
    return docs
