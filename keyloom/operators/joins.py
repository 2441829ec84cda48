"""Joins of a build relation R(key, payload) and a probe relation S(key).

A strategy is a function of both that gives all matches (inner), or the rows of S that
have one (semi) or none (anti). Those of this module leave the choice between broadcast
and shuffle to Catalyst, with a hint where the strategy is about just that; those of
``indexes`` look up through a structure of their own. Null keys never match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import indexes

Strategy = Callable[[DataFrame, DataFrame], DataFrame]


def _plain(how: str, hint: str | None = None) -> Strategy:
    def run(build: DataFrame, probe: DataFrame) -> DataFrame:
        right = build if how == "inner" else build.select("key")
        return probe.join(right.hint(hint) if hint else right, "key", how)

    return run


#: Bytes of R that one task may hold in a hash table.
HASHED = 64 << 20


def _hashed(build: DataFrame, probe: DataFrame) -> DataFrame:
    """A partitioned hash join, as long as Catalyst takes a partition of R for small enough; sort and merge beyond."""
    spark = build.sparkSession
    size = int(str(build._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    small = size <= HASHED * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return probe.join(build.hint("shuffle_hash" if small else "merge"), "key")


#: Strategy: (rows a probe gives, function).
STRATEGIES: dict[str, tuple[str, Strategy]] = {
    "auto": ("inner", _plain("inner")),
    "hash": ("inner", _hashed),
    "sort_merge": ("inner", _plain("inner", "merge")),
    "learned_index": ("inner", indexes.learned_index),
    "css_tree": ("inner", indexes.block_index),
    "learned_sort_merge": ("inner", indexes.sorted_merge),
    "chained": ("left_semi", _plain("left_semi")),
    "linear_probe": ("left_semi", indexes.hashed_slots),
    "cuckoo": ("left_semi", indexes.cuckoo),
    "gapped": ("left_semi", indexes.gapped),
    "radix_tree": ("left_semi", indexes.radix),
    "miss": ("left_anti", _plain("left_anti")),
}


def register(name: str, how: str, strategy: Strategy) -> None:
    """Adds a strategy of one's own; ``how`` is inner, left_semi or left_anti."""
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError(f"unknown kind of join {how!r}")
    STRATEGIES[name] = (how, strategy)


def join(build: DataFrame, probe: DataFrame, strategy: str = "auto", upsert_by: str | None = None) -> DataFrame:
    """Rows of ``probe`` with those of ``build`` that have their key, or without them for semi and anti strategies.

    ``upsert_by`` keeps, of build rows with one key, that with the greatest value of the column.
    """
    return STRATEGIES[strategy][1](upserted(build, upsert_by) if upsert_by else build, probe)


def bucketed_semi(build: DataFrame, probe: DataFrame, bucket: Column) -> DataFrame:
    """Semi-join on (bucket of the key, key): what a table with that bucket function looks up."""
    right = build.select("key").withColumn("bucket", bucket)
    return probe.withColumn("bucket", bucket).join(right, ["bucket", "key"], "left_semi").drop("bucket")


def upserted(build: DataFrame, seq: str) -> DataFrame:
    """Of the rows with one key, the last by ``seq``; ties go to the greatest row."""
    rest = [c for c in build.columns if c != "key"]
    return build.groupBy("key").agg(F.max(F.struct(seq, *[c for c in rest if c != seq])).alias("r")).select("key", *[F.col(f"r.{c}").alias(c) for c in rest])


def matches(build: DataFrame, probe: DataFrame, strategy: str = "auto", **kw) -> DataFrame:
    """One row, ``matches``: how many rows the join gives."""
    return join(build, probe, strategy, **kw).agg(F.count("*").alias("matches"))


def partition_counts(build: DataFrame, probe: DataFrame, part: Column) -> DataFrame:
    """Matches of each partition of the probe side, and their total next to it."""
    counts = join(build, probe).groupBy(part.alias("part")).agg(F.count("*").alias("matches"))
    return counts.withColumn("total", F.sum("matches").over(W.partitionBy()).cast("long"))


def multiplicities(build: DataFrame, probe: DataFrame) -> DataFrame:
    """How often each key matches, from counts of both sides: no pair is made."""
    r, s = build.groupBy("key").agg(F.count("*").alias("n_r")), probe.groupBy("key").agg(F.count("*").alias("n_s"))
    return r.join(s, "key").select("key", (F.col("n_r") * F.col("n_s")).alias("matches"))
