"""Small table helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def side_by_side(*one_row_tables: DataFrame) -> DataFrame:
    """One-row tables put next to each other in one row."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row_tables)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
