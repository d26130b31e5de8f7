"""Registry of the queries over trade documents, and DuckDB SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradeloom.plans import business, documents, dossiers, extraction, records

_ALL = [*documents.QUERIES, *dossiers.QUERIES, *business.QUERIES, *records.QUERIES, *extraction.QUERIES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q, _ in _ALL}


def oracle_sql() -> dict[str, str]:
    return {q.__name__: sql for q, sql in _ALL if sql}
