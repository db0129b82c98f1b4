"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import conversation, corpus, documents, hierarchy, search, service

MODULES = (search, conversation, documents, corpus, service, hierarchy)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_search(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
