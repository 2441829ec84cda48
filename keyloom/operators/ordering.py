"""Ranks and running values over a total order, without a one-task window.

Rows are dealt by range of the order and numbered inside their partition; what earlier
partitions add up to is a table of one row a partition, joined by broadcast. The
ordered rows are kept, so that both see the same partitions, until ``release``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_kept: list[DataFrame] = []


def release(spark: SparkSession) -> None:
    """Frees the ordered rows that ranks and running values keep; call it once their results are written."""
    for df in [d for d in _kept if d.sparkSession is spark]:
        _kept.remove(df)
        df.unpersist()


def dealt(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` in order, dealt by range, with ``_part`` and the place ``_at`` in it; kept until ``release``."""
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *columns).sortWithinPartitions(*columns).withColumn("_at", F.monotonically_increasing_id())
    ordered = ordered.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)).persist(StorageLevel.MEMORY_AND_DISK)
    _kept.append(ordered)
    return ordered


def earlier():
    """The frame of all earlier partitions, over a table of one row a partition."""
    return W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)


def _plus(a: Column, b: Column) -> Column:
    return (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).cast("long")


def _xor(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0).cast("long")).bitwiseXOR(F.coalesce(b, F.lit(0).cast("long")))


#: Kinds of running values: the aggregate, and how those of two stretches combine.
_KINDS = {"sums": (F.sum, _plus), "maxes": (F.max, F.greatest), "mins": (F.min, F.least), "xors": (F.bit_xor, _xor)}


def scan(df: DataFrame, order: Sequence[str | Column], rank: str | None = None, before: bool = False, **wanted: Mapping[str, str]) -> DataFrame:
    """``df`` with running values over a total order, up to and with each row, or up to the row ``before`` it.

    ``sums``, ``maxes``, ``mins`` and ``xors`` map new names to the columns they run over;
    ``rank`` names the place of each row, from 0.
    """
    ordered = dealt(df, order)
    values = [(name, column, *_KINDS[kind]) for kind, some in wanted.items() for name, column in some.items()]
    totals = ordered.groupBy("_part").agg(F.count("*").alias("_n"), *[f(column).alias(f"_t_{name}") for name, column, f, _ in values])
    offsets = totals.select("_part", F.coalesce(F.sum("_n").over(earlier()), F.lit(0)).alias("_n"), *[f(f"_t_{name}").over(earlier()).alias(f"_t_{name}") for name, _, f, _ in values])
    both = ordered.join(F.broadcast(offsets), "_part")
    upto = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1 if before else 0)
    new = {name: join(f(column).over(upto), F.col(f"_t_{name}")) for name, column, f, join in values}
    if rank is not None:
        new[rank] = (F.col("_at") + F.col("_n")).cast("long")
    return both.withColumns(new).select(*df.columns, *[n for n in new if n not in df.columns])


def ranked(df: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """``df`` with the place of each row, from 0, in a total order."""
    return scan(df, order, rank=name)


def running(df: DataFrame, order: Sequence[str | Column], **sums: str) -> DataFrame:
    """``df`` with running totals, each new name summing the column it names, up to and with each row."""
    return scan(df, order, sums=sums)


def running_max(df: DataFrame, order: Sequence[str | Column], column: str, name: str) -> DataFrame:
    """``df`` with the greatest ``column`` up to and with each row, and ``rank``."""
    return scan(df, order, rank="rank", maxes={name: column})


def first_places(df: DataFrame, key: str = "key", name: str = "first") -> DataFrame:
    """(key, first, rows) a key: the place of the first of its rows in the order of keys, found from counts alone."""
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("rows"))
    return scan(counts, ["key"], before=True, sums={name: "rows"}).select("key", name, "rows")
