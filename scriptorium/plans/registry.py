"""Queries by name, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.corpus import Corpus

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Corpus], DataFrame]], Callable[[Corpus], DataFrame]]:
    """Register a query over the corpus views."""

    def add(f: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add
