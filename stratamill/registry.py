"""Queries by name with the SQL that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratamill.plans import aggregates, basics, blocks, fits, gates, kernels, paths, retrieval, scores, series, spatial, streams, texts, vectors

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (aggregates, basics, series, texts, vectors, scores, paths, retrieval, spatial, fits, streams, kernels, gates, blocks)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
