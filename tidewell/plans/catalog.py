"""Registry of the queries on market series and of their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: The query that the smoke check runs.
FLAGSHIP = "valuation"
MODULES = ("rolling", "context", "validation", "records", "panel", "governance", "curves", "io", "bands")


def _modules() -> list:
    return [import_module(f"{__package__}.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
