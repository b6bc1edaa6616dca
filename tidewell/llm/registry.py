"""Registry of this subpackage's queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import anchor_dedup, bpe, fingerprint, hard_negatives, license_scan, mixing, ngram_join, quality, spelling, suffix_dedup, token_records, topk, url_filter

MODULES = (license_scan, mixing, topk, quality, ngram_join, suffix_dedup, bpe, fingerprint, anchor_dedup, url_filter, spelling, token_records, hard_negatives)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
