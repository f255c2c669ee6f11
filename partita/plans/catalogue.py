"""Registry of the engine's queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_assign, q_folds, q_graph, q_more, q_splits, q_stats, q_terms, q_wider

_MODULES = (q_folds, q_stats, q_graph, q_assign, q_terms, q_more, q_splits, q_wider)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["lpi_scaled"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for m in _MODULES for n, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q for m in _MODULES for n, q in m.ORACLE.items()}
