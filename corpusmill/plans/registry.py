"""Queries of the core by name, and their SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fact_queries, payload_queries, search_queries, store_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [text_queries, fact_queries, search_queries, store_queries, payload_queries]


def queries() -> dict[str, Query]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: f for m in MODULES for k, f in m.SQL.items()}
