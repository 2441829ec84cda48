"""A corpus pipeline of five stages: toxicity, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.

Edge cases: null and empty texts are not toxic, have no near duplicates and no personal
data, and their sizes are 0, so the mix takes a share of them without changing any
total; packed, each is its end id alone. Nulls in other columns are values like others,
a null number too. Repeated rows are near duplicates of each other, so one stays. An
empty table gives no rows. Further columns pass through to the last stage, which gives
its own; a column named like a working column of a stage (``score``, ``sequence_id``,
``offset``, ``_mix_...``, ``_nd_...``) is refused by that stage, not overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import mixing, near_duplicates, packing, pii, toxicity
from keyloom.llm._shared import made, persisted, swept


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, scored by a model of the labelled ones."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts."""
    return near_duplicates.dedupe(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' targets ask for."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, placed in sequences.

    Executors have served four stages by now, so encoders remember less than they do on their own.
    """
    return packing.packed(docs, remember=200_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Similarity joins, learned scores and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each kept as a table before the next; what led to it is deleted then."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = persisted(docs, name.replace(" ", "-"))
            swept(mark, docs)
    return docs
