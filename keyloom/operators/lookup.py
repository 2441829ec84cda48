"""Point, payload, next-N and range lookups of probe keys in a relation (key, payload).

Null keys of either side never match; a range with a null bound, or whose lower bound
is above the upper, holds nothing. Repeated query rows each get their answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import scan

#: Ranges over more bands than this are answered from running totals.
BANDS = 64


def point(relation: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes`` (probe_id, key) with ``found``, 1 or 0."""
    keys = relation.select("key").distinct().withColumn("found", F.lit(1))
    return probes.join(keys, "key", "left").withColumn("found", F.coalesce("found", F.lit(0)))


def payload(relation: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes`` with the payload of their key, null where there is none; keys of ``relation`` are unique."""
    return probes.join(relation.select("key", "payload"), "key", "left")


def _placed(relation: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the relation in order of (key, payload) with ``place``, from 1, and ``folded``, the exclusive or so far; and probes with both from before their key."""
    none = F.lit(None).cast("long")
    keys = relation.where("key is not null").select("key", F.col("payload").cast("long").alias("payload"), F.lit(1).alias("is_key"), none.alias("probe_id"))
    asked = probes.where("key is not null").select("key", none.alias("payload"), F.lit(0).alias("is_key"), "probe_id")
    both = scan(keys.unionByName(asked), ["key", "is_key", "payload", "probe_id"], sums={"place": "is_key"}, xors={"folded": "payload"})
    return both.where("is_key = 1").select("key", "payload", "place", "folded"), both.where("is_key = 0").select("probe_id", "key", "place", "folded")


def next_xor(relation: DataFrame, probes: DataFrame, n: int) -> DataFrame:
    """``probes`` with the exclusive or of the payloads of the ``n`` rows from the first key at or after theirs.

    Probes whose key is null or past the end give 0. What the rows before a probe fold to
    takes itself out of what the rows up to the last of the ``n`` fold to: one row a
    probe, one row a key, whatever ``n``.
    """
    rows, asked = _placed(relation, probes)
    size = relation.where("key is not null").count()
    upto = rows.select(F.col("place").alias("end"), F.col("folded").alias("upto"))
    ended = asked.withColumn("end", F.least(F.col("place") + n, F.lit(size).cast("long"))).join(upto, "end", "left")
    found = ended.select("probe_id", "key", F.coalesce(F.col("folded").bitwiseXOR(F.col("upto")), F.lit(0).cast("long")).alias("folded"))
    return found.unionByName(probes.where("key is null").select("probe_id", "key", F.lit(0).cast("long").alias("folded")))


def iterate(relation: DataFrame, probes: DataFrame, n: int) -> DataFrame:
    """(probe_id, step, key, payload): up to ``n`` rows in order of keys from the first key at or after each probe's."""
    rows, asked = _placed(relation, probes)
    steps = asked.select("probe_id", F.posexplode(F.sequence(F.col("place") + 1, F.col("place") + n)).alias("step", "place"))
    return steps.join(rows.select("place", "key", "payload"), "place").select("probe_id", "step", "key", "payload")


def walk(relation: DataFrame, start: int) -> DataFrame:
    """All rows from the first key at or after ``start``, in order."""
    return relation.where(F.col("key") >= start).orderBy("key", "payload")


def mixed(relation: DataFrame, probes: DataFrame, point_pct: int, n: int = 10) -> DataFrame:
    """Point payloads for ``point_pct`` of a hundred probes, by number, and ``n``-row scans for the others."""
    is_point = F.col("probe_id") % 100 <= point_pct
    points = payload(relation, probes.where(is_point)).select("probe_id", "key", F.coalesce("payload", F.lit(0).cast("long")).alias("folded"))
    return points.unionByName(next_xor(relation, probes.where(~is_point), n).select("probe_id", "key", "folded"))


def _answered(queries: DataFrame, sums: DataFrame) -> DataFrame:
    """``queries`` with the sums of their (query_id, lo, hi), 0 where there are none; a null number is a value."""
    right = sums.withColumnsRenamed({"query_id": "_id", "lo": "_lo", "hi": "_hi"})
    match = F.col("query_id").eqNullSafe(F.col("_id")) & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi"))
    zero = F.lit(0).cast("long")
    return queries.join(right, match, "left").drop("_id", "_lo", "_hi").withColumns({"n": F.coalesce("n", zero), "total": F.coalesce("total", zero)})


def _distinct(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")).where("lo <= hi").distinct()


def _by_prefix(relation: DataFrame, asked: DataFrame) -> DataFrame:
    none = F.lit(None).cast("long")
    keys = relation.where("key is not null").select(F.col("key").alias("k"), F.lit(1).alias("tag"), F.lit(1).alias("is_key"), F.col("payload").cast("long").alias("v"), none.alias("query_id"), none.alias("lo"), none.alias("hi"))
    bound = lambda c, tag: asked.select(F.col(c).alias("k"), F.lit(tag).alias("tag"), F.lit(0).alias("is_key"), F.lit(0).cast("long").alias("v"), "query_id", "lo", "hi")
    totals = scan(keys.unionByName(bound("lo", 0)).unionByName(bound("hi", 2)), ["k", "tag", "query_id"], sums={"n": "is_key", "s": "v"}).where("is_key = 0")
    sign = F.when(F.col("tag") == 2, 1).otherwise(-1)
    return totals.groupBy("query_id", "lo", "hi").agg(F.sum(F.col("n") * sign).cast("long").alias("n"), F.sum(F.col("s") * sign).cast("long").alias("total"))


def ranges(relation: DataFrame, queries: DataFrame) -> DataFrame:
    """``queries`` (query_id, lo, hi) with ``n`` and ``total``, count and payload sum of the keys in [lo, hi].

    Differences of running totals over one order of keys and bounds: bounds sort before
    (lo) and after (hi) equal keys. No query meets the keys it covers.
    """
    return _answered(queries, _by_prefix(relation, _distinct(queries)))


def ranges_by_band(relation: DataFrame, queries: DataFrame, width: int) -> DataFrame:
    """``ranges`` for short ranges: an equi-join on bands of ``width`` keys, then BETWEEN.

    Ranges over more than ``BANDS`` bands are answered from running totals, so no query
    gives more rows than that.
    """
    asked = _distinct(queries)
    short = F.floor(F.col("hi") / width) - F.floor(F.col("lo") / width) < BANDS
    bands = asked.where(short).withColumn("band", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    # Rows of one key come together first, so a range meets each key once.
    keys = relation.where("key is not null").groupBy("key").agg(F.count("*").alias("c"), F.sum("payload").cast("long").alias("v")).withColumn("band", F.floor(F.col("key") / width))
    hits = bands.join(keys, "band").where(F.col("key").between(F.col("lo"), F.col("hi")))
    sums = hits.groupBy("query_id", "lo", "hi").agg(F.sum("c").cast("long").alias("n"), F.sum("v").cast("long").alias("total"))
    wide = asked.where(~short)
    if wide.limit(1).count():
        sums = sums.unionByName(_by_prefix(relation, wide))
    return _answered(queries, sums)
