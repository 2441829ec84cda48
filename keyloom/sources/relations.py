"""Text relations, CSV results, JSON benchmark results, materialised relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reports import best_per_name

#: Column types of text relations.
TYPES = {"int": T.IntegerType(), "uint": T.LongType(), "long": T.LongType(), "ulong": T.DecimalType(20, 0), "double": T.DoubleType(), "long double": T.DoubleType()}


def schema(key: str = "uint", payload: str = "uint") -> T.StructType:
    return T.StructType([T.StructField("key", TYPES[key]), T.StructField("payload", TYPES[payload])])


def read_text(spark: SparkSession, path: str, key: str = "uint", payload: str = "uint", header: bool = True) -> DataFrame:
    """Rows ``key payload`` below a header line; ``path`` may match the parts of a relation. A line of another form fails."""
    reader = spark.read.schema(schema(key, payload)).option("sep", " ").option("mode", "FAILFAST")
    # The header names its columns in another form, so it is skipped, not matched.
    return reader.option("header", header).option("enforceSchema", True).csv(path)


def load_text(spark: SparkSession, path: str, rows: int, **kw) -> DataFrame:
    """A relation of just so many rows: the first ``rows`` of a longer file, an error for a shorter one."""
    out = read_text(spark, path, **kw).limit(rows)
    found = out.count()
    if found < rows:
        raise ValueError(f"{path} has {found} rows, not {rows}")
    return out


def free(df: DataFrame) -> None:
    """Gives back what a relation holds in executor storage."""
    df.unpersist()


def write_text(df: DataFrame, path: str, parts: int | None = None) -> None:
    """Writes ``key payload`` lines with a header, in ``parts`` files."""
    out = df.select(F.col("key").alias("#KEY,"), F.col("payload").alias("VAL"))
    (out.repartition(parts) if parts else out).write.option("sep", " ").option("header", True).option("quote", "\u0000").csv(path)


def materialize(df: DataFrame, path: str) -> None:
    """Writes a relation, and its keys in order below ``<path>_sorted``."""
    df.write.parquet(path)
    df.select("key").orderBy("key").write.parquet(f"{path}_sorted")


def write_csv(df: DataFrame, path: str) -> None:
    """Writes a result table, which is small, as one CSV file with a header."""
    df.coalesce(1).write.option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Reads a result table of whole numbers."""
    return spark.read.schema(T.StructType([T.StructField(c, T.LongType()) for c in columns])).option("header", True).csv(path)


_BENCHMARK = "context struct<num_cpus:int,mhz_per_cpu:int,date:string>, benchmarks array<struct<name:string,label:string,cpu_time:double,data_elem_count:double,table_bytes:double,table_directory_bytes:double,table_model_bytes:double,table_bits_per_key:double,point_lookup_percent:double>>"


def read_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """One row a benchmark of JSON result files."""
    return spark.read.schema(_BENCHMARK).option("multiLine", True).json(path).select(F.explode("benchmarks").alias("b")).select("b.*")


def write_json(df: DataFrame, path: str) -> None:
    """Writes results as lines of JSON, one a name: that of the least ``cpu_time``."""
    best_per_name(df).write.json(path)
