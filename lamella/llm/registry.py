"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codec, embedding_dedup, language_id, near_dedup, packing, pii, quality_rules, secret_scan, sharding, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.op1,
        "op2_secret_scan": secret_scan.op2,
        "op3_packing": packing.op3,
        "op4_embedding_dedup": embedding_dedup.op4,
        "op5_sharding": sharding.op5,
        "op6_url_filter": url_filter.op6,
        "op7_near_dedup": near_dedup.op7,
        "op8_language_id": language_id.op8,
        "op9_quality_rules": quality_rules.op9,
        "op10_bpe_codec": codec.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_embedding_dedup": embedding_dedup.oracle(),
        "op6_url_filter": url_filter.oracle(),
        "op7_near_dedup": near_dedup.oracle(),
        "op9_quality_rules": quality_rules.oracle(),
    }
