"""Quality rules with robust multivariate outliers, in DataFrame operations only.

``statistics`` counts words, symbols, repeated lines and repeated passages of whole
texts; ``verdicts`` rejects texts that break a base rule, and those whose
transformed statistics lie far from the others of their language and source. Centre
and scatter are minimum-covariance-determinant estimates: from two deterministic
starts, concentration steps keep the nearest three quarters of the group and
re-estimate from them, until that lessens no determinant; the start that ends with the
smaller determinant counts.

A concentration step is one aggregation: distances fall into bins, each with its
count, sums and sums of products as whole numbers, and running totals over the bins
of a group give the moments of the nearest part. So no step sorts or gathers a
group, sums are exact in any order, and a source with a third of all rows costs as
many rows after map-side aggregation as any other.

Edge cases: a null or empty text has no words and fails the base rule; null
languages and sources are values of their own; groups of fewer than ``LEAST``
documents, too few to estimate a scatter of five statistics, are pooled by language,
then all together, and a pool still smaller rejects nothing; repeated rows count and get equal verdicts; an empty table gives an
empty one. Other columns are carried along; names that the operator adds, and those
of its working columns, are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import looked_up, made, persisted, swept, without

#: Features, and the least standard deviation that an estimate may claim for each.
FEATURES = ("_q_f0", "_q_f1", "_q_f2", "_q_f3", "_q_f4")
FLOORS = (0.5, 0.05, 0.15, 0.35, 0.12)
#: Features are whole numbers of this unit, so that sums are exact.
UNIT = 1000
#: Documents that a group needs for estimates of its own: five for each statistic.
LEAST = 5 * len(FEATURES)
#: Share of a group that concentration steps keep, as a fraction, and by how much a step must lessen the log determinant of a factor to count.
KEEP, LESS = (3, 4), 1e-3
#: Squared distance from which a text is an outlier: the chi-square quantile of 5 degrees at about 1 - 1e-8.
CUT = 46.0
#: Median of chi-square with 5 degrees of freedom.
MEDIAN = 4.351
#: Estimates for up to this many groups are broadcast (under 400 bytes each); beyond, the join is salted.
BROADCAST = 20_000
_D = len(FEATURES)
_PAIRS = [(i, j) for i in range(_D) for j in range(i + 1)]


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumns(
        {
            "_q_words": F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""),
            "_q_lines": F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")),
            "n_symbols": F.length(text).cast("long") - F.length(F.translate(text, "#*$%&|<>", "")).cast("long"),
        }
    )
    # Hashes of 8 words by doubling: 1, 2, 4, 8; a place without enough words after it is cut off at the end.
    df = df.withColumn("_q_h", F.transform("_q_words", lambda w: F.xxhash64(w)))
    for k in (1, 2, 4):
        df = df.withColumn("_q_h", _joined_with(k))
    df = df.withColumn("_q_h", F.slice("_q_h", F.lit(1), F.greatest(F.size("_q_h") - 7, F.lit(0))))
    # Most texts repeat no window; only the others sort theirs, with places.
    pairs = F.sort_array(F.transform("_q_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_q_pairs", F.when(F.size(F.array_distinct("_q_h")) < F.size("_q_h"), pairs))
    same = lambda p, k: (F.get("_q_pairs", k - 1)["h"] == p["h"]) & (k > 0) | (F.get("_q_pairs", k + 1)["h"] == p["h"])
    df = df.withColumn("_q_places", F.sort_array(F.transform(F.filter("_q_pairs", lambda p, k: F.coalesce(same(p, k), F.lit(False))), lambda p: p["i"])))
    repeats = F.aggregate(F.transform("_q_places", lambda p, k: F.least(F.lit(8), F.coalesce(F.get("_q_places", k + 1) - p, F.lit(8)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(
        *docs.columns,
        F.size("_q_words").cast("long").alias("n_words"),
        F.length(F.array_join("_q_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeats, F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def _joined_with(k: int) -> Column:
    """Each hash together with that of ``k`` places on."""
    return F.transform("_q_h", lambda h, i: F.xxhash64(h, F.get("_q_h", i + k)))


def _features() -> dict[str, Column]:
    words, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    values = (
        F.log(words),
        F.log(chars / words),
        F.log(F.lit(1.0) + F.lit(100.0) * F.col("n_symbols") / chars),
        F.log(F.lit(1.0) + F.col("n_dup_lines")),
        F.sqrt(F.col("n_repeat_words") / words),
    )
    return {name: F.when(~F.col("base_failed"), F.round(v * UNIT).cast("long")) for name, v in zip(FEATURES, values, strict=True)}


def _factor(df: DataFrame) -> DataFrame:
    """Covariances ``c_i_j`` to the Cholesky factor ``l_i_j``; the floors keep it positive."""
    for i, j in _PAIRS:
        value = F.col(f"c_{i}_{j}") + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
        for k in range(j):
            value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        df = df.withColumn(f"l_{i}_{j}", F.sqrt(value) if i == j else value / F.col(f"l_{j}_{j}"))
    return df.select("_q_key", "_q_start", *[f"m_{i}" for i in range(_D)], *[f"l_{i}_{j}" for i, j in _PAIRS])


def _moments(n: Column, total, product) -> list[Column]:
    """Means and covariances, from a count and sums of whole numbers."""
    count = n.cast("double")
    mean = [total(i).cast("double") / count / UNIT for i in range(_D)]
    return [m.alias(f"m_{i}") for i, m in enumerate(mean)] + [(product(i, j).cast("double") / count / (UNIT * UNIT) - mean[i] * mean[j]).alias(f"c_{i}_{j}") for i, j in _PAIRS]


def _distances(rows: DataFrame, params: DataFrame, small: bool) -> DataFrame:
    """Each row with each estimate of its group, and the squared distance to it."""
    both = looked_up(rows, params, ["_q_key"], small, [*FEATURES, "doc_id"])
    for i in range(_D):
        value = F.col(FEATURES[i]).cast("double") / UNIT - F.col(f"m_{i}")
        for k in range(i):
            value = value - F.col(f"l_{i}_{k}") * F.col(f"y_{k}")
        both = both.withColumn(f"y_{i}", value / F.col(f"l_{i}_{i}"))
    total = F.col("y_0") * F.col("y_0")
    for i in range(1, _D):
        total = total + F.col(f"y_{i}") * F.col(f"y_{i}")
    return both.withColumn("_q_d2", total)


def _bin() -> Column:
    """Bins of the squared distance: sixteen to each doubling of 1 + d2."""
    return F.floor(F.log2(F.lit(1.0) + F.col("_q_d2")) * 16).cast("long")


def _starts(rows: DataFrame) -> DataFrame:
    """Median and quartile range of each feature; and plain mean and covariance. Two estimates a group."""
    long = rows.select("_q_key", F.posexplode(F.array(*FEATURES)).alias("i", "v"))
    bins = long.groupBy("_q_key", "i", F.floor(F.col("v") / 20).alias("b")).agg(F.count("*").alias("n"))
    of = W.partitionBy("_q_key", "i")
    ranked = bins.withColumn("upto", F.sum("n").over(of.orderBy("b").rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(of))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("b") * 20 + 10)).cast("double") / UNIT
    quartiles = ranked.groupBy("_q_key", "i").agg(at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3"))
    pick = lambda i, v: F.max(F.when(F.col("i") == i, v))
    scale = lambda i: pick(i, (F.col("q3") - F.col("q1")) / 1.349)
    robust = quartiles.groupBy("_q_key").agg(*[pick(i, F.col("q2")).alias(f"m_{i}") for i in range(_D)], *[(scale(i) * scale(i) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in _PAIRS])
    sums = rows.groupBy("_q_key").agg(F.count("*").alias("n"), *_sums())
    plain = sums.select("_q_key", *_moments(F.col("n"), lambda i: F.col(f"s_{i}"), lambda i, j: F.col(f"p_{i}_{j}")))
    return _factor(robust.withColumn("_q_start", F.lit(0)).unionByName(plain.withColumn("_q_start", F.lit(1))))


def _sums() -> list[Column]:
    return [F.sum(FEATURES[i]).alias(f"s_{i}") for i in range(_D)] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p_{i}_{j}") for i, j in _PAIRS]


def _concentrate(rows: DataFrame, params: DataFrame, small: bool) -> DataFrame:
    """Estimates from the nearest ``KEEP`` of each group, whole bins of distance."""
    bins = _distances(rows, params, small).groupBy("_q_key", "_q_start", _bin().alias("b")).agg(F.count("*").alias("n"), *_sums())
    of = W.partitionBy("_q_key", "_q_start")
    upto = of.orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    names = ["n", *[f"s_{i}" for i in range(_D)], *[f"p_{i}_{j}" for i, j in _PAIRS]]
    running = bins.select("_q_key", "_q_start", "b", F.sum("n").over(of).alias("all"), *[F.sum(x).over(upto).alias(x) for x in names])
    enough = running.where(F.col("n") * KEEP[1] >= F.col("all") * KEEP[0])
    nearest = enough.groupBy("_q_key", "_q_start").agg(F.min_by(F.struct(*names), "b").alias("x"))
    out = _factor(nearest.select("_q_key", "_q_start", *_moments(F.col("x.n"), lambda i: F.col(f"x.s_{i}"), lambda i, j: F.col(f"x.p_{i}_{j}"))))
    size = F.log(F.col("l_0_0"))
    for i in range(1, _D):
        size = size + F.log(F.col(f"l_{i}_{i}"))
    return out.withColumn("_q_size", size)


def _converged(rows: DataFrame, starts: DataFrame, small: bool) -> DataFrame:
    """The estimates of each group and start from which no step lessens the determinant; a step takes those that the one before improved."""
    mark = made()
    active = every = persisted(_concentrate(rows, starts, small), "mcd")
    own = ["_q_key", "_q_start"]
    while True:
        before = active.select(*own, F.col("_q_size").alias("_q_old"))
        # Kept before it is compared, so that the comparison isn't worked into the sums below.
        new = persisted(_concentrate(rows, active.drop("_q_size"), small), "mcd")
        active = persisted(new.join(before, own).where(F.col("_q_size") < F.col("_q_old") - LESS).drop("_q_old"), "mcd")
        if active.isEmpty():
            break
        every = every.unionByName(active)
    # Every step that counts lessens the determinant, so the least of a group and start is its last.
    rest = [c for c in every.columns if c not in own]
    last = persisted(every.groupBy(*own).agg(F.min_by(F.struct(*rest), "_q_size").alias("x")).select(*own, "x.*"), "mcd")
    swept(mark, last)
    return last


def estimates(rows: DataFrame) -> DataFrame:
    """(_q_key, centre, Cholesky factor, _q_scale) of each group of ``rows`` (_q_key, features)."""
    starts = persisted(_starts(rows), "mcd")
    small = starts.count() <= 2 * BROADCAST
    params = _converged(rows, starts, small)
    names = [c for c in params.columns if c not in ("_q_key", "_q_start", "_q_size")]
    best = params.groupBy("_q_key").agg(F.min_by(F.struct(*names), F.struct(F.round("_q_size", 9), "_q_start")).alias("x")).select("_q_key", F.lit(0).alias("_q_start"), *[F.col(f"x.{n}").alias(n) for n in names])
    best = persisted(best, "mcd")
    # The nearest part understates the scatter: the median distance says by how much.
    bins = _distances(rows, best, small).groupBy("_q_key", _bin().alias("b")).agg(F.count("*").alias("n"))
    of = W.partitionBy("_q_key")
    ranked = bins.select("_q_key", "b", F.sum("n").over(of).alias("all"), F.sum("n").over(of.orderBy("b").rowsBetween(W.unboundedPreceding, 0)).alias("upto"))
    median = ranked.where(F.col("upto") * 2 >= F.col("all")).groupBy("_q_key").agg(F.min("b").alias("b"))
    scale = median.select("_q_key", F.least(F.lit(1.0), F.lit(MEDIAN) / (F.pow(F.lit(2.0), (F.col("b") + 1) / 16.0) - 1.0)).alias("_q_scale"))
    return persisted(best.join(scale, "_q_key"), "mcd")


def _key(level: Column) -> Column:
    part = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c)))
    return F.when(level == 0, F.to_json(F.array(part("lang"), part("source")))).when(level == 1, F.to_json(F.array(part("lang")))).otherwise(F.lit("*"))


def verdicts(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, ``distance`` (squared, null if none) and ``kept``."""
    reserved = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept", "_q_key", "_q_own", "_q_level", "_q_enough", "_q_start", "_q_size", "_salt", "_q_words", "_q_lines", "_q_h", "_q_pairs", "_q_places", *FEATURES)
    without(docs, *reserved)
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    stats = persisted(statistics(docs).drop("text").withColumn("base_failed", base).withColumns(_features()), "statistics")
    usable = ~F.col("base_failed")
    # Levels: 0 with language and source, 1 with language, 2 all together.
    sizes = persisted(stats.where(usable).groupBy("lang", "source").agg(F.count("*").alias("n")), "sizes")
    pooled = F.sum(F.when(F.col("n") < LEAST, F.col("n")).otherwise(0)).over(W.partitionBy("lang"))
    levels = sizes.select("lang", "source", F.when(F.col("n") >= LEAST, 0).when(pooled >= LEAST, 1).otherwise(2).alias("_q_level"))
    few = sizes.count() <= BROADCAST
    # Nulls as values: the key of level 0 stands for language and source.
    levels = levels.select(_key(F.lit(0)).alias("_q_own"), "_q_level")
    keyed = looked_up(stats.where(usable).withColumn("_q_own", _key(F.lit(0))), levels, ["_q_own"], few, [*FEATURES, "doc_id"])
    rows = persisted(keyed.withColumn("_q_key", _key(F.col("_q_level"))).drop("_q_own", "_q_level"), "keyed")
    counted = persisted(rows.groupBy("_q_key").agg(F.count("*").alias("n")).select("_q_key", (F.col("n") >= LEAST).alias("_q_enough")), "counted")
    marked = looked_up(rows, counted, ["_q_key"], few, [*FEATURES, "doc_id"])
    params = estimates(persisted(marked.where("_q_enough").select("_q_key", "doc_id", *FEATURES), "fitted"))
    small = params.count() <= BROADCAST
    judged = _distances(rows, params, small)
    carried = [c for c in stats.columns if c not in FEATURES]
    measured = judged.select(*carried, (F.col("_q_d2") * F.col("_q_scale")).alias("distance"))
    rest = marked.where("not _q_enough").select(*carried, F.lit(None).cast("double").alias("distance"))
    failed = stats.where("base_failed").select(*carried, F.lit(None).cast("double").alias("distance"))
    every = measured.unionByName(rest).unionByName(failed)
    return every.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUT))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: statistics, base rule, verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return verdicts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 3).alias("distance"))
