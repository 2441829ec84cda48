"""Post-processing of benchmark results: best runs, new names, rates, labels, Pareto front."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import scan


def best_per_name(results: DataFrame) -> DataFrame:
    """For each name the row with the least ``cpu_time``; ties go to the least row."""
    rest = [c for c in results.columns if c not in ("name", "cpu_time")]
    return results.groupBy("name").agg(F.min(F.struct("cpu_time", *rest)).alias("r")).select("name", "r.*")


def new_names(every: DataFrame, existing: DataFrame, most: int = 1000) -> DataFrame:
    """The first ``most`` names that ``existing`` lacks, in order."""
    return every.select("name").distinct().join(existing.select("name"), "name", "left_anti").orderBy("name").limit(most)


def throughput(build_rows: Column, probe_rows: Column, ms: Column) -> Column:
    """Million tuples a second."""
    return (build_rows + probe_rows) / (ms * 1000.0)


def derived(results: DataFrame) -> DataFrame:
    """Results with ns_per_key and keys_per_second."""
    ns = F.col("cpu_time") / F.col("data_elem_count")
    return results.withColumns({"ns_per_key": ns, "keys_per_second": F.lit(1e9) / ns})


def labels(results: DataFrame) -> DataFrame:
    """``label`` as method, dataset and probe distribution; missing parts become a dash."""
    part = lambda i: F.coalesce(F.get(F.split("label", ":"), i), F.lit("-"))
    return results.withColumns({"method": part(0), "dataset": part(1), "probe_distribution": part(2), "range_size": F.regexp_extract("name", r",\s*(\d+)>", 1)})


def magnitude(n: Column) -> Column:
    """Round millions as text, such as 100M."""
    return F.concat(F.round(n / 1e6).cast("long").cast("string"), F.lit("M"))


def of_kind(results: DataFrame, word: str, least: float = 0) -> DataFrame:
    """Results whose name contains a word, from a number of elements on."""
    return results.where(F.lower("name").contains(word) & (F.col("data_elem_count") > least))


def pareto(results: DataFrame, x: str, y: str) -> DataFrame:
    """Rows that no other row beats in both ``x`` and ``y``, smaller being better.

    The best ``y`` for each ``x`` first, then the best of all smaller ``x`` by a running
    minimum, so any number of them is dealt.
    """
    best = results.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x).agg(F.min(y).alias(y))
    front = scan(best, [x], before=True, mins={"_before": y}).where(F.col("_before").isNull() | (F.col(y) < F.col("_before"))).drop("_before")
    return results.join(front, [x, y], "left_semi")


def by_share(results: DataFrame) -> DataFrame:
    """Results in order of name and share of point look-ups."""
    return results.orderBy("name", "point_lookup_percent")


def visible(results: DataFrame, hidden: str = "Prefetched") -> DataFrame:
    """Results whose method doesn't begin with a word."""
    return results.where(~F.col("method").startswith(hidden))


def latency(runs: DataFrame, group: str, nanoseconds: str, operations: str) -> DataFrame:
    """(group, ns): mean nanoseconds of an operation, over all runs of a group."""
    return runs.groupBy(group).agg((F.sum(nanoseconds) / F.sum(operations)).alias("ns"))


#: Fixed names of data sets and probe distributions in labels, by number.
DATASETS = ("seq", "gap_10", "uniform", "normal", "wiki", "osm", "fb", "Variance_2", "Variance_4", "Variance_half", "Variance_quarter")
PROBES = ("uniform", "exponential_sorted", "exponential_random")


def named(number: Column, names: tuple[str, ...]) -> Column:
    """The name with a number; a dash without one."""
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), number.cast("int")), F.lit("-"))


def label(method: Column, dataset: Column, probes: Column) -> Column:
    """The label of a run, which ``labels`` takes apart."""
    return F.concat_ws(":", method, named(dataset, DATASETS), named(probes, PROBES))


def median_and_min(runs: DataFrame, group: str, value: str) -> DataFrame:
    return runs.groupBy(group).agg(F.min(value).alias("least"), F.percentile_approx(value, 0.5).alias("median"))
