"""Sorting, merging, partitioning by a learned distribution, heavy hitters, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sort(df: DataFrame, *keys: str) -> DataFrame:
    """A total order: rows dealt by range, sorted where they lie."""
    return df.orderBy(*keys)


def merge(*sorted_frames: DataFrame, key: str = "key") -> DataFrame:
    """The rows of several relations in one order."""
    out = sorted_frames[0]
    for f in sorted_frames[1:]:
        out = out.unionByName(f)
    return out.orderBy(key)


def dedupe(df: DataFrame, key: str = "key") -> DataFrame:
    """One row a key, in order."""
    return df.dropDuplicates([key]).orderBy(key)


def cdf_partition(df: DataFrame, part: Column, parts: int, most: int = 4) -> DataFrame:
    """``df`` (key) with ``part`` and ``piece``, dealt and sorted by them: partitioning by a predicted distribution.

    A part with more than ``most`` times the mean of rows is dealt as several pieces, so
    neither a bad prediction nor a frequent key is one task. ``parts`` bounds the parts.
    """
    marked = df.withColumn("part", part)
    counts = marked.groupBy("part").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_mean", F.avg("_n").over(W.partitionBy()))  # one row a part
    pieces = counts.select("part", F.when(F.col("_n") > most * F.col("_mean"), F.ceil(F.col("_n") / F.col("_mean"))).otherwise(1).alias("_pieces"))
    dealt = marked.join(F.broadcast(pieces), "part").withColumn("piece", F.floor(F.rand(0) * F.col("_pieces")).cast("long")).drop("_pieces")
    return dealt.repartition(parts, "part", "piece").sortWithinPartitions("part", "piece", "key")


def cdf_histogram(df: DataFrame, part: Column) -> DataFrame:
    """(part, rows) by predicted partition."""
    return df.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))


def heavy_hitters(df: DataFrame, least: int, key: str = "key") -> DataFrame:
    """(key, rows) of the keys with at least ``least`` rows."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("rows")).where(F.col("rows") >= least)


def compressed(df: DataFrame, key: str = "key") -> DataFrame:
    """Sorted runs as (key, rows); ``expanded`` gives the rows back."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("rows")).orderBy("key")


def expanded(runs: DataFrame) -> DataFrame:
    return runs.select("key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("_i")).drop("_i")


def shuffled(df: DataFrame, seed: int = 0, key: str = "key") -> DataFrame:
    """The rows in an order that only the seed decides."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
