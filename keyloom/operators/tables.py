"""Layouts of hash tables as rows: where each key lies under a collision scheme.

A bucket function is a column: a hash reduced to the directory, a model's prediction
or a rank; every scheme takes any of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import dealt, earlier


def directory_size(n: int, bucket_size: int, overalloc: int) -> int:
    """Buckets of a table of ``n`` keys: ``overalloc`` percent more slots than keys, or from 10000 on a load in percent."""
    if overalloc < 10000:
        return (100 + n * (100 + overalloc)) // (100 * bucket_size)
    return 1 + n * (overalloc - 10000) // (100 * bucket_size)


def chained(df: DataFrame, bucket: Column, bucket_size: int) -> DataFrame:
    """``df`` (key) with ``bucket``, ``chain_pos`` and ``slot``; keys of a bucket in order."""
    place = F.row_number().over(W.partitionBy("bucket").orderBy("key")) - 1
    return df.withColumn("bucket", bucket).withColumn("_i", place).withColumns({"chain_pos": F.floor(F.col("_i") / bucket_size).cast("long"), "slot": (F.col("_i") % bucket_size).cast("long")}).drop("_i")


def linear_probe(df: DataFrame, ideal: Column, bucket_size: int = 1) -> DataFrame:
    """``df`` (key, unique) with ``ideal`` bucket, ``actual`` slot and ``run``, inserted in order of (ideal, key).

    A key lies at its rank plus the greatest lead of an ideal bucket's first slot over the
    rank so far; bucket b holds slots b * bucket_size on. Slots past the directory form a
    tail behind it. Keys whose slots follow each other without a gap share a run, which
    is their slot less their rank. One pass over one order gives rank and lead.
    """
    columns = list(df.columns)
    ordered = dealt(df.withColumn("ideal", ideal), ["ideal", "key"])
    lead = F.col("ideal") * bucket_size - F.col("_at")
    totals = ordered.groupBy("_part").agg(F.count("*").alias("_n"), F.max(lead).alias("_top"))
    placed = totals.select("_part", F.coalesce(F.sum("_n").over(earlier()), F.lit(0)).alias("_n"), "_top")
    offsets = placed.select("_part", "_n", F.max(F.col("_top") - F.col("_n")).over(earlier()).alias("_before"))
    upto = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    run = F.greatest(F.max(lead).over(upto) - F.col("_n"), F.col("_before"))
    both = ordered.join(F.broadcast(offsets), "_part").withColumn("run", run.cast("long"))
    return both.withColumn("actual", (F.col("run") + F.col("_at") + F.col("_n")).cast("long")).select(*columns, "ideal", "actual", "run")


def runs(layout: DataFrame) -> DataFrame:
    """(run, first, last, keys): stretches of occupied slots without a gap."""
    return layout.groupBy("run").agg(F.min("actual").alias("first"), F.max("actual").alias("last"), F.count("*").alias("keys"))


def cuckoo_candidates(df: DataFrame, b1: Column, b2: Column, buckets: int) -> DataFrame:
    """``df`` with both candidate buckets; a second equal to the first moves on by one."""
    both = df.withColumns({"b1": b1, "b2": b2})
    return both.withColumn("b2", F.when(F.col("b1") == F.col("b2"), (F.col("b2") + 1) % buckets).otherwise(F.col("b2")).cast("long"))


def cuckoo_primary(candidates: DataFrame, bucket_size: int) -> DataFrame:
    """``candidates`` with ``primary``: whether a key is among the first that its first bucket holds."""
    return candidates.withColumn("primary", (F.row_number().over(W.partitionBy("b1").orderBy("key")) <= bucket_size).cast("int"))


def _balanced(order: Column, other_fill: Column, bias: int) -> list[Column]:
    """Those with more room elsewhere go first."""
    return [F.desc(other_fill), order]


def _biased(order: Column, other_fill: Column, bias: int) -> list[Column]:
    """Keys in their first bucket stay, but in ``bias`` percent of cases."""
    luck = F.pmod(order, F.lit(100)) < bias
    return [F.when(luck, F.lit(0)).otherwise(F.col("is_primary")).desc(), order]


#: Who stays in an overfull bucket, first to last: a function of a random order, the keys in the other bucket, and the bias in percent.
KICKING: dict[str, Callable[[Column, Column, int], list[Column]]] = {"balanced": _balanced, "biased": _biased, "unbiased": lambda order, other, bias: _biased(order, other, 0)}


def cuckoo_layout(candidates: DataFrame, bucket_size: int, kicking: str = "balanced", bias: int = 0, most_rounds: int = 500, seed: int = 0) -> DataFrame:
    """(key, b1, b2, bucket, is_primary): one table of all keys, none of whose buckets holds more than it may.

    All keys start in their first bucket. In each round the keys that an overfull bucket
    has no room for move to their other bucket, until none moves; ``kicking`` says who
    stays, with chance from a hash of key, round and ``seed``. A round is one shuffle by
    bucket, so a table of any size is built side by side. Repeated keys, and those whose
    candidates are null, are to be dropped before. Raises if keys still move after
    ``most_rounds``.
    """
    from ..functions.hashing import murmur32
    from ..session import discarded, written

    if kicking not in KICKING:
        raise ValueError(f"unknown kicking {kicking!r}")
    state = written(candidates.select("key", "b1", "b2", F.lit(1).alias("is_primary")))
    for turn in range(most_rounds):
        here, there = F.when(F.col("is_primary") == 1, F.col("b1")).otherwise(F.col("b2")), F.when(F.col("is_primary") == 1, F.col("b2")).otherwise(F.col("b1"))
        placed = state.withColumns({"bucket": here, "other": there})
        fill = placed.groupBy("bucket").agg(F.count("*").alias("fill"))
        full = fill.where(F.col("fill") > bucket_size)
        if not full.limit(1).count():
            return placed.drop("other")
        # Only keys of overfull buckets compete; the fill of the other bucket decides where kicking asks for it.
        rivals = placed.join(full.select("bucket"), "bucket").join(fill.select(F.col("bucket").alias("other"), F.col("fill").alias("_fill")), "other", "left")
        order = murmur32(F.col("key").bitwiseXOR(F.lit(seed * 1_000_003 + turn * 7919 + 1)))
        rank = F.row_number().over(W.partitionBy("bucket").orderBy(*KICKING[kicking](order, F.coalesce("_fill", F.lit(0)), bias), "key"))
        gone = rivals.select("key", rank.alias("_rank")).where(F.col("_rank") > bucket_size).select("key", F.lit(1).alias("_gone"))
        before, state = state, written(state.join(gone, "key", "left").select("key", "b1", "b2", F.when(F.col("_gone").isNull(), F.col("is_primary")).otherwise(1 - F.col("is_primary")).alias("is_primary")))
        discarded(before)
    raise RuntimeError("no place found; allow more buckets")


def _bits(total: Column) -> Column:
    return (total * 8.0 / F.col("n")).alias("bits_per_key")


def chained_bytes(layout: DataFrame, buckets: int, bucket_size: int, slot_bytes: int = 16, pointer_bytes: int = 8, model_bytes: int = 0) -> DataFrame:
    """One row: ``table_bytes`` of a chained table with one bucket inline for each directory entry, and ``bits_per_key``."""
    one = bucket_size * slot_bytes + pointer_bytes
    per = layout.groupBy("bucket").agg(F.count("*").alias("n"))
    extra = F.sum(F.greatest(F.ceil(F.col("n") / bucket_size) - 1, F.lit(0)))
    total = (F.lit(buckets * one + model_bytes) + F.coalesce(extra, F.lit(0)) * one).cast("long")
    return per.agg(total.alias("table_bytes"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")).select("table_bytes", _bits(F.col("table_bytes")))


def open_bytes(keys: DataFrame, buckets: int, bucket_size: int, slot_bytes: int = 16, model_bytes: int = 0) -> DataFrame:
    """One row: bytes of a table without chains (linear probing, cuckoo), whose directory holds every slot, and ``bits_per_key``."""
    total = F.lit(buckets * bucket_size * slot_bytes + model_bytes).cast("long")
    return keys.agg(F.count("*").alias("n")).select(total.alias("table_bytes"), _bits(total))


def rank_bytes(keys: DataFrame, payload_bytes: int = 8, hash_bits: float = 3.0) -> DataFrame:
    """One row: bytes of a sorted payload array under a perfect hash of ``hash_bits`` bits a key, and ``bits_per_key``."""
    total = F.ceil(F.col("n") * (payload_bytes + hash_bits / 8)).cast("long")
    return keys.agg(F.count("*").alias("n")).select(total.alias("table_bytes"), _bits(total))


def model_bytes(leaves: int) -> int:
    """Bytes of a two-level linear model: slope and intercept for the root and each leaf."""
    return 16 * (leaves + 1)
