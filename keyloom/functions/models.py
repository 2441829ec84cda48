"""Learned models of a key distribution: exact ranks, two-level linear models, error-bounded pieces.

A model is a small table; a prediction is a join with it or a look-up in it, and
columns. Keys are distinct and not null; other rows are dropped by ``key_set``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordering import ranked, scan
from .hashing import bounded, linear

#: Leaves of a model that are broadcast, and worked out in one task (24 bytes each); beyond, they are dealt and joined.
SMALL = 1_000_000


def key_set(df: DataFrame, key: str = "key") -> DataFrame:
    """The distinct keys."""
    return df.select(F.col(key).cast("long").alias("key")).where("key is not null").distinct()


def rank_model(keys: DataFrame) -> DataFrame:
    """(key, rank): the monotone perfect hash of a key set."""
    return ranked(keys.select("key"), "key")


def checked(leaves: int = 100, eps: float = 16.0, share: float = 0.01, parts: int = 1) -> dict:
    """Parameters of models within their bounds: what lies beyond becomes the default, and types are checked."""
    for name, value in (("leaves", leaves), ("parts", parts)):
        if not isinstance(value, int):
            raise TypeError(f"{name} is a whole number")
    return {"leaves": leaves if 1 <= leaves <= 50_000_000 else 100, "eps": float(eps) if eps >= 1 else 16.0, "share": share if 0 < share <= 1 else 0.01, "parts": max(1, parts)}


@dataclass(frozen=True)
class Rmi:
    """A linear root over linear leaves, with the ranked keys that it was trained on."""

    placed: DataFrame
    model: DataFrame
    n: int
    low: int
    high: int
    leaves: int

    def predict(self, df: DataFrame, buckets: int) -> DataFrame:
        """``df`` (key) with ``cdf`` and ``bucket``, its place among ``buckets``."""
        return predict_rmi(df, self.model, self.low, self.high, self.leaves, buckets)


def fit_rmi(keys: DataFrame, leaves: int, distinct: bool = True) -> Rmi:
    """A model of ``keys`` (key); ranked once, for training and for whatever comes after.

    Unless ``distinct``, rows with one key count as often as they occur, and ``placed`` keeps their other columns.
    """
    placed = rank_model(keys) if distinct else ranked(keys.where("key is not null"), "key")
    n, low, high = placed.agg(F.count("*"), F.min("key"), F.max("key")).first()
    low, high = low or 0, high or 0
    return Rmi(placed, _leaves(placed, n, low, high, leaves), n, low, high, leaves)


def train_rmi(keys: DataFrame, leaves: int) -> DataFrame:
    """(leaf, slope, intercept) of a linear root over ``leaves`` linear leaves, y from 0 to 1."""
    return fit_rmi(keys, leaves).model


def fit_both(r: DataFrame, s: DataFrame, leaves: int) -> Rmi:
    """One model of the keys of two relations, each key as often as both have it."""
    return fit_rmi(r.select("key").unionAll(s.select("key")), leaves, distinct=False)


def _leaves(placed: DataFrame, n: int, low: int, high: int, leaves: int) -> DataFrame:
    """A leaf runs from the last point of the leaf before to its own last point; an empty
    leaf holds the level reached. Root routing truncates, in training as in prediction."""
    routed = placed.select("key", (F.col("rank") / F.lit(float(max(n, 1)))).alias("y"), root(F.col("key"), low, high, leaves).alias("leaf"))
    points = routed.groupBy("leaf").agg(F.count("*").alias("n"), F.min("key").alias("x0"), F.min("y").alias("y0"), F.max("key").alias("x1"), F.max("y").alias("y1"))
    dense = placed.sparkSession.range(leaves).select(F.col("id").alias("leaf")).join(points, "leaf", "left")
    if leaves <= SMALL:
        before = W.orderBy("leaf").rowsBetween(W.unboundedPreceding, -1)
        p = dense.withColumns({"px": F.max("x1").over(before), "py": F.max("y1").over(before)})
    else:
        p = scan(dense, ["leaf"], before=True, maxes={"px": "x1", "py": "y1"})
    p = p.withColumns({"n": F.coalesce("n", F.lit(0).cast("long")), "py": F.coalesce("py", F.lit(0.0))})
    first, last = F.col("leaf") == 0, F.col("leaf") == leaves - 1
    end = F.when(last, F.lit(1.0)).otherwise(F.col("y1"))
    width = F.when(first, F.col("x1") - F.col("x0")).otherwise(F.col("x1") - F.col("px")).cast("double")
    rise = F.when(first, F.col("y1")).otherwise(end - F.col("py"))
    flat = (first & (F.col("n") < 2)) | (F.col("n") == 0) | (width <= 0)
    slope = F.when(flat, F.lit(0.0)).otherwise(rise / F.when(width > 0, width))
    level = F.when(first, F.lit(0.0)).when(last, F.lit(1.0)).otherwise(F.col("py"))
    start = F.when(first, F.col("y0") - slope * F.col("x0").cast("double")).otherwise(F.col("py") - slope * F.col("px").cast("double"))
    return p.select("leaf", slope.alias("slope"), F.when(flat, level).otherwise(start).alias("intercept"))


def root(key: Column, low: int, high: int, leaves: int) -> Column:
    """The leaf that a key is routed to."""
    scale = (leaves - 1.0) / (high - low) if high > low else 0.0
    return bounded(F.floor((key - low).cast("double") * F.lit(scale)), 0, leaves - 1).cast("long")


def predict_rmi(df: DataFrame, model: DataFrame, low: int, high: int, leaves: int, n: int) -> DataFrame:
    """``df`` (key) with ``cdf`` and ``bucket``, its place among ``n``."""
    table = F.broadcast(model) if leaves <= SMALL else model
    routed = df.withColumn("leaf", root(F.col("key"), low, high, leaves)).join(table, "leaf")
    cdf = linear(F.col("key").cast("double"), F.col("slope"), F.col("intercept"))
    return routed.withColumn("cdf", cdf).withColumn("bucket", bounded(F.floor(F.col("cdf") * n), 0, n - 1).cast("long")).drop(*[c for c in model.columns if c not in df.columns])


def with_errors(rmi: Rmi) -> DataFrame:
    """The model with ``error`` for each leaf: how far, in places, a key of the leaf lies from where the model puts it at most."""
    guess = rmi.predict(rmi.placed, max(rmi.n, 1)).withColumn("leaf", root(F.col("key"), rmi.low, rmi.high, rmi.leaves))
    errors = guess.groupBy("leaf").agg(F.max(F.abs(F.col("bucket") - F.col("rank"))).alias("error"))
    return rmi.model.join(errors, "leaf", "left").withColumn("error", F.coalesce("error", F.lit(0).cast("long")))


def segments(keys: DataFrame, eps: float) -> DataFrame:
    """(first_key, slope, first_rank, n): linear pieces whose rank error is at most ``eps``.

    Pieces are the largest stretches of 2**l ranks, from a multiple of 2**l on, whose
    chord stays within the bound. Every level is an aggregation over all keys, so pieces
    depend on the keys alone, not on how they are dealt.
    """
    placed = rank_model(keys)
    n = placed.count()
    # Stretches of up to eps + 1 ranks always stay within the bound.
    least = int(math.log2(eps + 1))
    levels = list(range(least, max(least, (n - 1).bit_length() if n else 0) + 1))
    every = placed.select("key", "rank", F.explode(F.array(*[F.lit(x) for x in levels])).alias("level")).withColumn("i", F.expr("shiftright(rank, level)"))
    ends = every.groupBy("level", "i").agg(F.min("key").alias("x0"), F.max("key").alias("x1"), F.min("rank").alias("y0"), F.max("rank").alias("y1"))
    ends = ends.withColumn("slope", F.when(F.col("x1") > F.col("x0"), (F.col("y1") - F.col("y0")).cast("double") / (F.col("x1") - F.col("x0"))).otherwise(F.lit(0.0)))
    off = F.abs(F.col("y0") + F.col("slope") * (F.col("key") - F.col("x0")) - F.col("rank"))
    fits = every.join(ends, ["level", "i"]).groupBy("level", "i").agg(F.max(off).alias("error")).where(F.col("error") <= eps).select("level", "i")
    # A piece inside a larger one that fits is none.
    inner = fits.select("level", "i", F.explode(F.expr(f"filter(array({', '.join(map(str, levels))}), x -> x > level)")).alias("up")).withColumn("ui", F.expr("shiftright(i, up - level)"))
    held = inner.join(fits.select(F.col("level").alias("up"), F.col("i").alias("ui")), ["up", "ui"], "left_semi").select("level", "i").distinct()
    return fits.join(held, ["level", "i"], "left_anti").join(ends, ["level", "i"]).select(F.col("x0").alias("first_key"), "slope", F.col("y0").alias("first_rank"), (F.col("y1") - F.col("y0") + 1).alias("n"))


def radix_table(pieces: DataFrame, bits: int, low: int, high: int) -> DataFrame:
    """(prefix, first_key): for each value of the upper ``bits`` bits of a key less ``low`` that a piece begins with, its first piece."""
    shift = max(0, (high - low).bit_length() - bits)
    return pieces.groupBy(F.shiftright(F.col("first_key") - low, shift).alias("prefix")).agg(F.min("first_key").alias("first_key"))


def spline(keys: DataFrame, knots: int) -> DataFrame:
    """(first_key, slope, first_rank, n): pieces between ``knots`` equally filled ranges of ranks."""
    placed = rank_model(keys)
    n = placed.count()
    step = max(1, -(-n // knots))
    ends = placed.where((F.col("rank") % step == 0)).select(F.col("key").alias("first_key"), F.col("rank").alias("first_rank"))
    after = W.orderBy("first_key")  # one row a knot
    rise = (F.lead("first_rank").over(after) - F.col("first_rank")).cast("double") / (F.lead("first_key").over(after) - F.col("first_key"))
    return ends.select("first_key", F.coalesce(rise, F.lit(0.0)).alias("slope"), "first_rank", F.least(F.lit(step), F.lit(n) - F.col("first_rank")).cast("long").alias("n"))


def predict_segments(df: DataFrame, model: DataFrame) -> DataFrame:
    """``df`` (key) with ``predicted``, the rank that the piece at or before the key gives.

    Pieces and keys meet in one running order, so the model may have any size.
    """
    numbered = ranked(model, "first_key", name="piece")
    both = df.select("key", F.lit(1).alias("tag"), F.lit(-1).cast("long").alias("piece")).unionByName(numbered.select(F.col("first_key").alias("key"), F.lit(0).alias("tag"), "piece"))
    found = scan(both, ["key", "tag"], maxes={"of": "piece"}).where("tag = 1").select("key", "of")
    return found.join(numbered, found["of"] == numbered["piece"]).select("key", (F.col("first_rank") + F.col("slope") * (F.col("key") - F.col("first_key"))).alias("predicted"))
