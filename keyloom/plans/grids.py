"""Grids of parameters: one row for each choice, from one plan.

The choices are few and known beforehand, so a grid is a union of small aggregates of
one key set; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import joins, stats, tables

#: Hash functions of a grid, as columns and as SQL.
_HASHES = {"murmur32": (H.murmur32, H.murmur32_sql), "identity": (lambda k: k, lambda k: k)}


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    if out is None:
        raise ValueError("a grid needs a choice")
    return out


def chained(keys: DataFrame, overallocs: tuple[int, ...], bucket_size: int = 4) -> DataFrame:
    """(hash, overalloc, buckets, used, longest): what chained tables of every size and hash function look like."""
    n = keys.count()

    def one(name: str, overalloc: int) -> DataFrame:
        buckets = max(1, tables.directory_size(n, bucket_size, overalloc))
        per = keys.groupBy(H.mod(_HASHES[name][0](F.col("key")), buckets).alias("bucket")).agg(F.count("*").alias("n"))
        return per.agg(F.lit(name).alias("hash"), F.lit(overalloc).alias("overalloc"), F.lit(buckets).cast("long").alias("buckets"), F.count("*").alias("used"), F.max("n").alias("longest"))

    return _union(one(name, x) for name in _HASHES for x in overallocs)


def _size_sql(overalloc: int, bucket_size: int) -> str:
    if overalloc < 10000:
        return f"(n * {100 + overalloc} + 100) // {100 * bucket_size}"
    return f"1 + (n * {overalloc - 10000}) // {100 * bucket_size}"


def chained_sql(table: str, key: str, overallocs: tuple[int, ...], bucket_size: int = 4) -> str:
    one = "SELECT '{name}' AS hash, {x} AS overalloc, max(buckets) AS buckets, count(*) AS used, max(c) AS longest FROM (SELECT {h} % buckets AS bucket, any_value(buckets) AS buckets, count(*) AS c FROM k, (SELECT CAST({size} AS BIGINT) AS buckets FROM (SELECT count(*) AS n FROM k)) GROUP BY 1)"
    parts = [one.format(name=name, x=x, h=f"({sql('key')})", size=_size_sql(x, bucket_size)) for name, (_, sql) in _HASHES.items() for x in overallocs]
    return f"WITH k AS (SELECT {key} AS key FROM {table}) " + " UNION ALL ".join(parts)


def probe(keys: DataFrame, overallocs: tuple[int, ...]) -> DataFrame:
    """(overalloc, moved, farthest): how many keys linear probing moves, and how far at most, by size of the table."""
    n = keys.count()

    def one(overalloc: int) -> DataFrame:
        layout = tables.linear_probe(keys.select("key"), H.mod(H.murmur32(F.col("key")), max(1, tables.directory_size(n, 1, overalloc))))
        distances = stats.displacement(layout)
        return distances.agg(F.lit(overalloc).alias("overalloc"), F.coalesce(F.sum(F.when(F.col("distance") > 0, F.col("keys"))), F.lit(0)).cast("long").alias("moved"), F.max("distance").alias("farthest"))

    return _union(one(x) for x in overallocs)


def probe_sql(table: str, key: str, overallocs: tuple[int, ...]) -> str:
    one = "SELECT {x} AS overalloc, count(*) FILTER (WHERE actual > ideal) AS moved, max(actual - ideal) AS farthest FROM (SELECT ideal, i + max(ideal - i) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS actual FROM (SELECT ideal, row_number() OVER (ORDER BY ideal, key) - 1 AS i FROM (SELECT key, ({h}) % CAST({size} AS BIGINT) AS ideal FROM k, (SELECT count(*) AS n FROM k))))"
    return f"WITH k AS (SELECT {key} AS key FROM {table}) " + " UNION ALL ".join(one.format(x=x, h=H.murmur32_sql("key"), size=_size_sql(x, 1)) for x in overallocs)


def matrix(spark: SparkSession, inputs: Mapping[str, tuple[DataFrame, DataFrame]], strategies: Iterable[str]) -> DataFrame:
    """(input, strategy, matches): every strategy on every pair of relations."""
    return _union(joins.matches(build, probe, x).select(F.lit(name).alias("input"), F.lit(x).alias("strategy"), "matches") for name, (build, probe) in inputs.items() for x in strategies)


def matrix_sql() -> str:
    cases = {"auto": "JOIN r USING (key)", "css_tree": "JOIN r USING (key)", "chained": "WHERE key IN (SELECT key FROM r)", "linear_probe": "WHERE key IN (SELECT key FROM r)", "miss": "WHERE key NOT IN (SELECT key FROM r)"}
    sides = {"orders": "s", "misses": "t"}
    return "WITH r AS (SELECT o_orderkey AS key FROM orders), s AS (SELECT l_orderkey AS key FROM lineitem), t AS (SELECT l_orderkey * 2 AS key FROM lineitem) " + " UNION ALL ".join(f"SELECT '{name}' AS input, '{x}' AS strategy, count(*) AS matches FROM {side} {rest}" for name, side in sides.items() for x, rest in cases.items())
