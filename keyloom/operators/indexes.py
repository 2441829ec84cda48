"""Joins through an index structure: the keys of R are laid out, and probes find where to look.

Each takes R(key, anything) and S(key, anything). Inner joins give the rows of S with
those of R that have their key; semi joins rows of S whose key R has. Null keys never
match. An index is a column (block, run, bucket) that both sides get, the probes by a
bounded search, so that the equi-join on (that column, key) is the look-up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import models as M
from . import tables
from .ordering import scan


def _known(df: DataFrame) -> DataFrame:
    return df.where(F.col("key").isNotNull())


def learned_index(build: DataFrame, probe: DataFrame, leaves: int = 100) -> DataFrame:
    """Inner join through a model of the places of R's sorted rows.

    A leaf's error bounds how far a key's rows lie from the place it predicts, so a probe
    looks at that stretch only: the sorted rows form blocks as wide as the widest stretch,
    of which any stretch meets two at most.
    """
    rmi = M.fit_rmi(build.withColumnsRenamed({c: f"_b_{c}" for c in build.columns if c != "key"}), leaves, distinct=False)
    if not rmi.n:
        return probe.limit(0).join(build, "key")
    model = M.with_errors(rmi)
    width = 2 * (model.agg(F.max("error")).first()[0] or 0) + 1
    rows = rmi.placed.withColumn("_block", F.floor(F.col("rank") / width)).drop("rank")
    named = model.withColumnsRenamed({c: f"_{c}" for c in model.columns})
    routed = _known(probe).withColumn("_leaf", M.root(F.col("key"), rmi.low, rmi.high, rmi.leaves)).join(F.broadcast(named) if leaves <= M.SMALL else named, "_leaf")
    place = H.bounded(F.floor(H.linear(F.col("key").cast("double"), F.col("_slope"), F.col("_intercept")) * rmi.n), 0, rmi.n - 1).cast("long")
    block = lambda x: F.floor(H.bounded(x, 0, rmi.n - 1) / width)
    looked = routed.withColumn("_block", F.explode(F.sequence(block(place - F.col("_error")), block(place + F.col("_error")))))
    return looked.join(rows, ["_block", "key"]).select(*probe.columns, *[F.col(f"_b_{c}").alias(c) for c in build.columns if c != "key"])


def block_index(build: DataFrame, probe: DataFrame, every: int = 64) -> DataFrame:
    """Inner join through a directory of the first of every so many distinct keys of R.

    Directory, rows and probes meet in one order; each row goes to the block whose first
    key is the last at or before its own, and blocks are joined.
    """
    keys = M.rank_model(M.key_set(build))
    first = keys.where(F.col("rank") % every == 0).select("key", F.lit(0).alias("_side"), F.floor(F.col("rank") / every).alias("_first"))
    rest_b, rest_p = [c for c in build.columns if c != "key"], [c for c in probe.columns if c != "key"]
    pack = lambda cols: F.struct(*cols) if cols else F.struct(F.lit(0).alias("_none"))
    none = F.lit(None).cast("long").alias("_first")
    rows = _known(build).select("key", F.lit(1).alias("_side"), none, pack(rest_b).alias("_b"))
    asked = _known(probe).select("key", F.lit(2).alias("_side"), none, pack(rest_p).alias("_p"))
    every_row = first.unionByName(rows, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)
    found = scan(every_row, ["key", "_side"], maxes={"_block": "_first"})
    left = found.where("_side = 2 and _block is not null").select("_block", "key", *[F.col(f"_p.{c}").alias(c) for c in rest_p])
    right = found.where("_side = 1").select("_block", "key", *[F.col(f"_b.{c}").alias(c) for c in rest_b])
    return left.join(right, ["_block", "key"]).select(*probe.columns, *rest_b)


def slot_lookup(layout: DataFrame, probe: DataFrame, slot: Column) -> DataFrame:
    """Semi join with a layout of ``tables.linear_probe``: a probe searches the run of occupied slots that its ideal slot lies in.

    Runs and probes meet in one order of slots; the last run that begins at or before a
    slot is the only one that may hold it.
    """
    begins = tables.runs(layout).select(F.col("first").alias("_slot"), F.lit(0).alias("_side"), F.col("run").alias("_begun"))
    rest = [c for c in probe.columns if c != "key"]
    asked = _known(probe).select(slot.alias("_slot"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_begun"), "key", *rest)
    # Runs are numbered in the order of their slots.
    found = scan(begins.unionByName(asked, allowMissingColumns=True), ["_slot", "_side"], maxes={"run": "_begun"}).where("_side = 1 and run is not null")
    return found.join(layout.select("run", "key"), ["run", "key"], "left_semi").select(*probe.columns)


def hashed_slots(build: DataFrame, probe: DataFrame, overalloc: int = 34) -> DataFrame:
    """Semi join with linear probing by hash."""
    keys = M.key_set(build)
    slots = max(1, tables.directory_size(keys.count(), 1, overalloc))
    ideal = H.mod(H.murmur32(F.col("key")), slots)
    return slot_lookup(tables.linear_probe(keys, ideal), probe, ideal)


def gapped(build: DataFrame, probe: DataFrame, leaves: int = 100, factor: float = 1.3) -> DataFrame:
    """Semi join with an array that a model spreads the keys over, ``factor`` times as long as they are many."""
    rmi = M.fit_rmi(M.key_set(build), leaves)
    if not rmi.n:
        return probe.limit(0)
    slots = int(rmi.n * factor) + 1
    layout = tables.linear_probe(rmi.predict(rmi.placed.select("key"), slots).select("key", "bucket"), F.col("bucket"))
    asked = rmi.predict(_known(probe), slots)
    return slot_lookup(layout.select("key", "actual", "run"), asked, F.col("bucket")).select(*probe.columns)


def cuckoo_lookup(layout: DataFrame, probes: DataFrame) -> DataFrame:
    """Semi join with a layout of ``tables.cuckoo_layout``; ``probes`` (key, b1, b2) look into both buckets. A key lies in one of them only, so no row comes twice."""
    looked = probes.withColumn("bucket", F.explode(F.array("b1", "b2")))
    return looked.join(layout.select("bucket", "key"), ["bucket", "key"], "left_semi").select(*probes.columns)


def cuckoo(build: DataFrame, probe: DataFrame, bucket_size: int = 4, overalloc: int = 34) -> DataFrame:
    """Semi join with a cuckoo table of two hash functions."""
    keys = M.key_set(build)
    buckets = max(2, tables.directory_size(keys.count(), bucket_size, overalloc))
    h = H.murmur32(F.col("key"))
    both = lambda df: tables.cuckoo_candidates(df, H.mod(h, buckets), H.mod(H.murmur32(h.bitwiseXOR(F.lit(408957))), buckets), buckets)
    return cuckoo_lookup(tables.cuckoo_layout(both(keys), bucket_size), both(_known(probe))).select(*probe.columns)


def radix(build: DataFrame, probe: DataFrame, bits: int = 12) -> DataFrame:
    """Semi join on the upper bits of a key, which a radix tree branches by, and the key."""
    keys = M.key_set(build)
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None:
        return probe.limit(0)
    inside = _known(probe).where(F.col("key").between(low, high))
    prefix = H.radix_prefix(F.col("key"), low, high, bits)
    return inside.withColumn("_prefix", prefix).join(keys.withColumn("_prefix", prefix), ["_prefix", "key"], "left_semi").select(*probe.columns)


def sorted_merge(build: DataFrame, probe: DataFrame, leaves: int = 100, parts: int = 64) -> DataFrame:
    """Inner join of partitions that one model of both sides predicts, each sorted and merged."""
    rmi = M.fit_both(build, probe, leaves)
    part = lambda df: M.predict_rmi(_known(df), rmi.model, rmi.low, rmi.high, rmi.leaves, parts).drop("cdf").withColumnRenamed("bucket", "_part_of")
    return part(probe).join(part(build).hint("merge"), ["_part_of", "key"]).select(*probe.columns, *[c for c in build.columns if c != "key"])
