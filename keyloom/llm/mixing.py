"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source gets a target by water filling; each of its documents expects
``target / source size`` copies. The running total of expected copies, plus one
offset for the source, crosses whole numbers; a document is taken once for each
that it crosses. Documents run in order of size, so that every stretch of sizes
gives its share and the words taken stay near the target.

Edge cases: a null text has no words; documents without words have size 0 and
take part without changing any total; a null source is a source of its own, the
last; repeated rows are separate documents; an empty table gives an empty one.
Other columns are carried along; names that start with ``_mix_`` are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import persisted, without, words

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Most copies of a source, and so of a document.
MOST = 3

_OWN = ("_mix_salt", "_mix_tie", "_mix_at", "_mix_part", "_mix_first", "_mix_before", "_mix_source_size", "_mix_target", "_mix_offset", "_mix_size", "_mix_copies", "_mix_row")


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) with ``target``: all sizes shared by weight, none above ``MOST`` times its size.

    The level at which the excess comes to rest: with sources by the ratio of
    their cap to their weight, the first k are capped if the level that the rest
    then reaches is at least the k-th ratio. One row a source, so the windows
    over all of them stay small.
    """
    weights = F.array(*[F.lit(w).cast("long") for w in WEIGHTS])
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sources.withColumn("weight", F.element_at(weights, (rank % len(WEIGHTS) + 1).cast("int")))
    by_ratio = W.orderBy((F.lit(MOST) * F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    upto, everything = by_ratio.rowsBetween(W.unboundedPreceding, 0), W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = weighed.select(
        "source",
        "source_size",
        "weight",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("weights"),
        F.sum("source_size").over(upto).alias("size_upto"),
        F.sum("weight").over(upto).alias("weight_upto"),
    )
    # A source is capped if, with it and all before it capped, no less than its own level is left for the rest.
    capped = (F.col("total") - MOST * (F.col("size_upto") - F.col("source_size"))) * F.col("weight") >= MOST * F.col("source_size") * (F.col("weights") - F.col("weight_upto") + F.col("weight"))
    flagged = ranked.withColumn("capped", capped)
    # Capping is downward closed in the order by ratio, so plain totals over the capped ones are enough.
    cap_size = F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(everything), F.lit(0))
    cap_weight = F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(everything), F.lit(0))
    share = (F.col("weight") * (F.col("total") - MOST * cap_size)).cast("double") / (F.col("weights") - cap_weight).cast("double")
    target = F.when(F.col("capped"), (F.lit(MOST) * F.col("source_size")).cast("double")).otherwise(share)
    return flagged.select("source", "source_size", target.alias("target"))


def plan(sized: DataFrame, seed: int = 0) -> DataFrame:
    """``sized`` (source, _mix_size, anything else) with source size, target and copies of each row.

    One shuffle by range of (source, size) puts the documents in order. Row numbers
    within a source come from the numbers of its rows in earlier partitions, a table of
    one row for each source and partition, so a source that holds a third of all rows is
    spread over as many tasks as its share.
    """
    tie = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    keys = [F.col("source").asc_nulls_last(), F.col("_mix_size"), F.col("_mix_tie"), F.col("doc_id"), F.col("_mix_salt")]
    ordered = sized.withColumns({"_mix_tie": tie, "_mix_salt": F.rand(seed)}).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = persisted(ordered.withColumn("_mix_at", F.monotonically_increasing_id()).drop("_mix_salt", "_mix_tie"), "mix")
    rows = rows.withColumn("_mix_part", F.shiftright("_mix_at", 33))
    parts = rows.groupBy("source", "_mix_part").agg(F.min("_mix_at").alias("_mix_first"), F.count("*").alias("n"), F.sum("_mix_size").cast("long").alias("size"))
    parts = persisted(parts, "mix-parts")
    goals = targets(parts.groupBy("source").agg(F.sum("size").alias("source_size")))
    goals = goals.withColumnsRenamed({"source": "_goal_source", "source_size": "_mix_source_size", "target": "_mix_target"})
    before = F.sum("n").over(W.partitionBy("source").orderBy("_mix_part").rowsBetween(W.unboundedPreceding, -1))
    offset = (F.conv(F.substring(F.md5(F.concat(F.coalesce("source", F.lit("")), F.lit(f"#{seed}")).cast("binary")), 1, 5), 16, 10).cast("double") + 0.5) / 1048576
    info = parts.withColumn("_mix_before", F.coalesce(before, F.lit(0))).withColumn("_mix_offset", offset).drop("n", "size")
    info = info.join(goals, F.col("source").eqNullSafe(F.col("_goal_source"))).drop("_goal_source")
    info = info.withColumnsRenamed({"source": "_info_source", "_mix_part": "_info_part"})
    # A range partition holds a bounded number of rows, so no key of this join is large.
    joined = rows.join(info, (F.col("_mix_part") == F.col("_info_part")) & F.col("source").eqNullSafe(F.col("_info_source")))
    rank = F.col("_mix_before") + F.col("_mix_at") - F.col("_mix_first")
    rate = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size").cast("double")).otherwise(F.lit(0.0))
    copies = (F.floor((rank + 1).cast("double") * rate + F.col("_mix_offset")) - F.floor(rank.cast("double") * rate + F.col("_mix_offset"))).cast("long")
    out = joined.withColumn("_mix_copies", F.least(copies, F.lit(MOST).cast("long")))
    return out.drop("_mix_at", "_mix_part", "_mix_first", "_mix_before", "_mix_offset", "_info_source", "_info_part")


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` with every document as often as the mix takes it; same columns.

    Only numbers and sizes go through the order by size; texts are joined back by row
    number, dealt by its hash, so that no task gets all long texts of a source.
    """
    without(docs, *_OWN)
    numbered = docs.withColumns({"_mix_size": F.size(words(F.col("text"))).cast("long"), "_mix_row": F.monotonically_increasing_id()})
    rows = persisted(numbered, "mix-rows")
    planned = plan(rows.select("_mix_row", "doc_id", "source", "_mix_size"), seed).where("_mix_copies > 0").select("_mix_row", "_mix_copies")
    repeated = rows.join(planned, "_mix_row").withColumn("_mix_salt", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies"))))
    return repeated.select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its size, its source's size and target, the words taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("_mix_size"))
    return plan(sized).select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_copies") * F.col("_mix_size")).alias("taken"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sources),
ranked AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         sum(source_size) OVER w AS size_upto, sum(weight) OVER w AS weight_upto
  FROM weighed
  WINDOW w AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
flagged AS (
  SELECT *, (total - 3 * (size_upto - source_size)) * weight >= 3 * source_size * (weights - weight_upto + weight) AS capped
  FROM ranked),
rest AS (
  SELECT coalesce(sum(CASE WHEN capped THEN source_size END), 0) AS cap_size, coalesce(sum(CASE WHEN capped THEN weight END), 0) AS cap_weight
  FROM flagged),
goals AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST(weight * (total - 3 * cap_size) AS DOUBLE) / CAST(weights - cap_weight AS DOUBLE) END AS target,
         (CAST(('0x' || substr(md5(coalesce(source, '') || '#0'), 1, 5)) AS BIGINT) + 0.5e0) / 1048576e0 AS shift
  FROM flagged, rest),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.shift,
         CASE WHEN g.source_size > 0 THEN g.target / CAST(g.source_size AS DOUBLE) ELSE 0e0 END AS rate,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, md5(coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id) - 1 AS pos
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(least(3, CAST(floor((pos + 1) * rate + shift) AS BIGINT) - CAST(floor(pos * rate + shift) AS BIGINT)) * size AS BIGINT) AS taken
FROM placed
"""
