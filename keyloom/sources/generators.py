"""Key sets, relations and probe workloads, reproducible from a seed.

Random choices come from ``murmur32`` of the row number and the seed, so that the same
rows appear under any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import murmur32
from ..operators.ordering import ranked, running

TWO32, TWO40 = 4294967296, 1 << 40


def mixed(seed: int) -> int:
    """The 32-bit finalizer of a seed, worked out once."""
    x = seed & 0xFFFFFFFF
    x = (x ^ x >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    x = (x ^ x >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return x ^ x >> 16


def unit(i: Column, seed: int, stream: int = 0) -> Column:
    """A number in (0, 1) for each row number; numbers repeat after 2**32 rows."""
    return (murmur32((i + (stream * 7919 + 1)).bitwiseXOR(F.lit(mixed(seed)))) + 0.5) / float(TWO32)


def _normal(i: Column, seed: int) -> Column:
    """A standard normal number, cut to nine decimals so that no last bit of a logarithm decides."""
    return F.floor(F.sqrt(-2.0 * F.log(unit(i, seed, 1))) * F.cos(6.283185307179586 * unit(i, seed, 2)) * 1e9) / 1e9


def sequential(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select((F.col("id") * 10 + 20000).alias("key"))


def gapped(spark: SparkSession, n: int, skip: float = 0.1, step: int = 10, seed: int = 0) -> DataFrame:
    """Steps of ``step``, each key skipped with a probability, any number of times in a row."""
    import math

    jumps = F.floor(F.log(unit(F.col("id"), seed)) / math.log(skip)) + 1
    return running(spark.range(n).select("id", jumps.alias("jump")), ["id"], steps="jump").select((F.col("steps") * step).alias("key"))


def uniform(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Distinct uniform keys up to 2**40; a few fewer than ``n``."""
    return spark.range(n).select(F.floor(unit(F.col("id"), seed) * TWO40 + unit(F.col("id"), seed, 3) * 256).alias("key")).distinct()


def variance(spark: SparkSession, n: int, factor: float, seed: int = 0) -> DataFrame:
    """Sorted uniform keys with their deviation from an even spread scaled by ``factor``; clamped at 0, distinct."""
    placed = ranked(uniform(spark, n, seed), "key", name="i")
    even = F.col("i") * (TWO40 / n)
    return placed.select(F.greatest(F.floor(even + (F.col("key") - even) * factor), F.lit(0)).alias("key")).distinct()


#: Factors of the deviation, by name: twice and four times the variance, half and a quarter.
VARIANCES = {"variance_2": 1.414, "variance_4": 2.0, "variance_half": 1 / 1.414, "variance_quarter": 0.5}


def normal(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Normal keys: mean 100, deviation 20, cut at three deviations, scaled by 2**40; distinct."""
    x = F.least(F.greatest(_normal(F.col("id"), seed) * 20 + 100, F.lit(40.0)), F.lit(160.0))
    return spark.range(n).select(F.floor((x - 40) * TWO40).alias("key")).distinct()


def unique32(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """``n`` distinct keys below 2**32: the finalizer is one to one, so row numbers give them without a look at others."""
    return spark.range(n).select(murmur32(F.col("id").bitwiseXOR(F.lit(mixed(seed)))).alias("key"))


def tuples(spark: SparkSession, keys: list[int], payloads: list[int] | None = None) -> DataFrame:
    """A relation of given keys; payloads are places unless given."""
    return spark.createDataFrame([(k, i if payloads is None else payloads[i]) for i, k in enumerate(keys)], "key long, payload long")


def band(keys: DataFrame, low: float, high: float, offset: int) -> DataFrame:
    """Keys whose binary logarithm lies in a band, less an offset."""
    return keys.where((F.col("key") > 0) & F.log2("key").between(low, high)).select((F.col("key") - offset).alias("key"))


def fb(keys: DataFrame) -> DataFrame:
    return band(keys, 35.01, 35.99, 1 << 35)


def osm(keys: DataFrame) -> DataFrame:
    return band(keys, 62.01, 62.99, 1 << 62)


def wiki(keys: DataFrame) -> DataFrame:
    """Keys as they are stored."""
    return keys.select("key")


#: Stored data sets: file, bytes a key takes, and what becomes of the keys.
STORED = {"fb": ("fb_200M_uint64", 8, fb), "osm": ("osm_cellids_200M_uint64", 8, osm), "wiki": ("wiki_ts_200M_uint64", 8, wiki), "books64": ("books_200M_uint64", 8, wiki), "books32": ("books_200M_uint32", 4, wiki)}


def stored(spark: SparkSession, folder: str, name: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` distinct keys of a stored data set below ``folder``; an unknown name is an error."""
    from .binary_keys import read_keys

    file, width, keep = STORED[name]
    return sample(keep(read_keys(spark, f"{folder}/{file}", width, dedupe=False)), n, seed)


def de_sentinel(keys: DataFrame, sentinel: int) -> DataFrame:
    """Keys of which none is the sentinel: it becomes the key below."""
    return keys.withColumn("key", F.when(F.col("key") == sentinel, F.col("key") - 1).otherwise(F.col("key")))


def self_payload(keys: DataFrame) -> DataFrame:
    """Payload as the key itself."""
    return keys.select("key", F.col("key").alias("payload"))


def sample(keys: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` distinct keys in an order that the seed decides."""
    return keys.distinct().orderBy(murmur32(F.col("key").bitwiseXOR(F.lit(seed))), "key").limit(n)


def with_payload(keys: DataFrame) -> DataFrame:
    """Payload as the key less 5, signed."""
    return keys.select("key", (F.col("key") - 5).alias("payload"))


def primary_keys(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").alias("key"), F.lit(0).cast("long").alias("payload"))


def foreign_keys(spark: SparkSession, n: int, most: int) -> DataFrame:
    """Whole rounds of 1 to ``most``, then the beginning of another."""
    return spark.range(n).select((F.col("id") % most + 1).alias("key"), F.col("id").alias("payload"))


def holes(spark: SparkSession, n: int, share: float = 0.1, seed: int = 0) -> DataFrame:
    """``n`` distinct keys of 1 to (1 + share) n."""
    return sample(spark.range(1, int(n * (1 + share)) + 1).select(F.col("id").alias("key")), n, seed)


def skewed(spark: SparkSession, n: int, kind: str, scale: float, seed: int = 0, sigma: float = 1.0) -> DataFrame:
    """Foreign keys with duplicates: normal, uniform, exponential or lognormal, times ``scale``."""
    i = F.col("id")
    draw = {"uniform": unit(i, seed), "normal": _normal(i, seed), "exponential": -F.log(unit(i, seed)), "lognormal": F.exp(_normal(i, seed) * sigma)}[kind]
    return spark.range(n).select(F.floor(F.abs(draw) * scale).alias("key"), i.alias("payload"))


def probes(keys: DataFrame, n: int, hit: float = 1.0, kind: str = "uniform", seed: int = 0) -> DataFrame:
    """(probe_id, key): keys drawn by place, ``hit`` of them present and the others moved off the key set.

    kinds: uniform; exponential_sorted, more from small keys; exponential_random, more
    from keys that the seed decides. Moved keys that meet another key are dropped to one
    below the least key less their number, which no key has.
    """
    order = ["key"] if kind != "exponential_random" else [murmur32(F.col("key").bitwiseXOR(F.lit(seed + 1))), F.col("key")]
    placed = ranked(keys.select("key").distinct(), *order, name="place")
    size, least = placed.agg(F.count("*"), F.min("key")).first()
    i = F.col("probe_id")
    share = unit(i, seed) if kind == "uniform" else F.least(-F.log(unit(i, seed)) / 10, F.lit(1 - 1e-12))
    drawn = keys.sparkSession.range(n).withColumnRenamed("id", "probe_id").withColumn("place", F.floor(share * size).cast("long"))
    picked = drawn.join(placed, "place").select("probe_id", "key", (unit(i, seed, 5) < hit).alias("hits"))
    moved = picked.withColumn("near", F.when(F.col("hits"), F.col("key")).otherwise(F.col("key") + 1 + F.floor(unit(i, seed, 6) * 331777).cast("long")))
    known = keys.select(F.col("key").alias("near"), F.lit(True).alias("known")).distinct()
    return moved.join(known, "near", "left").select("probe_id", F.when(F.col("hits") | F.col("known").isNull(), F.col("near")).otherwise(F.lit(least - 1) - F.col("probe_id")).alias("key"))


def range_queries(keys: DataFrame, n: int, sizes: tuple[int, ...] = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024), seed: int = 0) -> DataFrame:
    """(query_id, lo, hi): from a drawn place to the key some places on; sizes take turns."""
    placed = ranked(keys.select("key").distinct(), "key", name="place")
    size = placed.count()
    q = keys.sparkSession.range(n).withColumnRenamed("id", "query_id")
    steps = F.element_at(F.array(*[F.lit(s) for s in sizes]), (F.col("query_id") % len(sizes) + 1).cast("int"))
    q = q.withColumn("place", F.floor(unit(F.col("query_id"), seed) * size).cast("long")).withColumn("end", F.least(F.col("place") + steps, F.lit(size - 1)))
    low = q.join(placed.select("place", F.col("key").alias("lo")), "place")
    return low.join(placed.select(F.col("place").alias("end"), F.col("key").alias("hi")), "end").select("query_id", "lo", "hi")


_cache: dict[tuple, DataFrame] = {}


def cached(name: str, make, spark: SparkSession, *args, probe_side: bool = False) -> DataFrame:
    """A data set made once for its session, name, arguments and side, and kept in executor storage until ``uncached``.

    The probe side draws from a seed of its own and keeps repeated keys; the build side's keys are distinct.
    """
    at = (spark.sparkContext.applicationId, name, probe_side, *map(str, args))
    if at not in _cache:
        made = make(spark, *args, seed=1) if probe_side else make(spark, *args)
        _cache[at] = (made if probe_side else made.dropDuplicates(["key"])).persist()
    return _cache[at]


def uncached(spark: SparkSession) -> None:
    """Frees the data sets that ``cached`` keeps for a session."""
    for at in [a for a in _cache if a[0] == spark.sparkContext.applicationId]:
        _cache.pop(at).unpersist()
