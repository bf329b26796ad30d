"""Registered queries: operator key -> (Spark callable, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.inputs import Inputs, inputs, portable
from registry.oracle_views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``build(inputs) -> DataFrame`` under ``key`` with its oracle."""
    def register(build: Callable[[Inputs], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate key {key}")
        QUERIES[key] = lambda spark, sf_dir: portable(build(inputs(spark, sf_dir)))
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return build
    return register


def joined(column: str):
    """An array of texts as one text, so both engines return plain values."""
    return F.array_join(column, "; ").alias(column)


from registry import clinical, text_queries  # noqa: E402,F401  (fill the two dicts)
