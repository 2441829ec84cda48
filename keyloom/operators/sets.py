"""Set operations on key relations; rows count as often as they occur unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def except_names(every: DataFrame, existing: DataFrame, column: str = "name") -> DataFrame:
    """Rows whose ``column`` doesn't occur in ``existing``."""
    return every.join(existing.select(column).distinct(), column, "left_anti")


def with_holes(keys: DataFrame, holes: DataFrame) -> DataFrame:
    """Keys less the holes."""
    return keys.join(holes.select("key"), "key", "left_anti")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)
