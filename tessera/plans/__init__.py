"""Registered queries of the analytics operators, each beside SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> dict[str, tuple[Query, str | None]]:
    """name: (query, DuckDB SQL or None)."""
    from tessera.plans import budgets, conversations, files, gates, memories, requests, searches, selection, streams, texts

    found: dict[str, tuple[Query, str | None]] = {}
    for module in (texts, budgets, gates, selection, conversations, requests, files, memories, searches, streams):
        found |= module.QUERIES
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
