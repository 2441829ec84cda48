"""Diagnostics of key distributions and table layouts, each as a small histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import scan
from .tables import runs


def occupancy(buckets: DataFrame, n_buckets: int) -> DataFrame:
    """(keys, buckets): how many buckets hold how many keys, empty ones too. ``buckets`` has ``bucket``.

    Empty buckets are counted, not listed: all buckets less those that occur.
    """
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("keys")).groupBy("keys").agg(F.count("*").alias("buckets"))
    used = sizes.agg((F.lit(n_buckets) - F.coalesce(F.sum("buckets"), F.lit(0))).cast("long").alias("buckets")).select(F.lit(0).cast("long").alias("keys"), "buckets")
    return sizes.unionByName(used.where("buckets > 0"))


def displacement(layout: DataFrame) -> DataFrame:
    """(distance, keys): distance of keys from their ideal slots."""
    return layout.groupBy((F.col("actual") - F.col("ideal")).alias("distance")).agg(F.count("*").alias("keys"))


def run_lengths(layout: DataFrame) -> DataFrame:
    """(keys, runs): how many runs of occupied slots have how many keys. ``layout`` comes from ``tables.linear_probe``."""
    return runs(layout).groupBy("keys").agg(F.count("*").alias("runs"))


def distance_to_empty(layout: DataFrame) -> DataFrame:
    """(distance, slots): steps from each occupied slot to the next empty one.

    A run of length n has one slot at each distance from 1 to n, so the lengths of runs
    say it all: at distance d are as many slots as there are runs of length d or more.
    """
    lengths = run_lengths(layout)
    by = W.orderBy("keys")  # one row a length of run
    steps = lengths.select(F.coalesce(F.lag("keys").over(by), F.lit(0)).alias("_from"), "keys", F.sum("runs").over(by.rowsBetween(0, W.unboundedFollowing)).cast("long").alias("slots"))
    return steps.select(F.explode(F.sequence(F.col("_from") + 1, F.col("keys"))).alias("distance"), "slots")


def primary_ratio(placed: DataFrame, column: str = "primary") -> DataFrame:
    """One row, ``ratio``: the share of keys in their first bucket."""
    return placed.agg(F.avg(F.col(column).cast("double")).alias("ratio"))


def primary_ratio_of(placed: DataFrame, keys: DataFrame, column: str = "primary") -> DataFrame:
    """``primary_ratio`` of the given keys; those that the table lacks, and null ones, don't count."""
    return primary_ratio(placed.join(keys.select("key").distinct(), "key", "left_semi"), column)


def gaps(predicted: DataFrame, n: int) -> DataFrame:
    """(bin, gaps): differences of neighbouring predictions in units of 1/n, in bins of two hundredths. ``predicted`` has ``cdf``.

    In order, the greatest prediction before a row is the one next to it.
    """
    placed = scan(predicted.select("cdf"), ["cdf"], before=True, maxes={"last": "cdf"}).where("last is not null")
    gap = (F.col("cdf") - F.col("last")) * n
    return placed.groupBy((F.ceil(gap * 50 - 0.1) * 2).cast("long").alias("bin")).agg(F.count("*").alias("gaps"))


def max_collision(predicted: DataFrame) -> DataFrame:
    """One row, ``most``: the most keys that one place gets. ``predicted`` has ``bucket``."""
    return predicted.groupBy("bucket").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))


def max_guess(predicted: DataFrame) -> DataFrame:
    """One row, ``most``: the greatest place that a model gives a key. ``predicted`` has ``bucket``."""
    return predicted.agg(F.max("bucket").alias("most"))
