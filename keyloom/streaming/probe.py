"""A stream of probe keys against a static relation, and windowed hit counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def probe(stream: DataFrame, build: DataFrame, how: str = "left_semi") -> DataFrame:
    """Each micro-batch of ``stream`` (key, ...) joined with the static relation."""
    right = build.select("key").distinct() if how in ("left_semi", "left_anti") else build
    if how == "left_anti":  # a stream can't be anti-joined in place: mark, then filter
        marked = stream.join(right.withColumn("_found", F.lit(True)), "key", "left")
        return marked.where(F.col("_found").isNull()).drop("_found")
    return stream.join(right, "key", how)


def hits_by_window(stream: DataFrame, build: DataFrame, time: str, window: str, delay: str) -> DataFrame:
    """(start, matches) of tumbling windows; rows later than ``delay`` are dropped by the watermark."""
    found = probe(stream.withWatermark(time, delay), build)
    return found.groupBy(F.window(time, window)).agg(F.count("*").alias("matches")).select(F.col("window.start").alias("start"), "matches")
