"""Token counts from flat files without an index, by a scan for end-of-document ids.

A flat file is nothing but ids of a fixed width, with an end id after each
document. Blocks of all files are searched side by side; each gives the places of
its end ids and one summary row. A prefix scan over the summaries tells each block
where the document that it begins in started, and how many documents came before.

Edge cases: a null text is an empty one, a document of 0 tokens; a last document
without an end id is counted, with ``ended`` false; null and repeated document
numbers are carried through; an empty file or table gives no rows. A document may
span any number of blocks. Other input columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._files import created, listed, read_range
from ._shared import encoder as encoder_of
from ._shared import new_path, persisted, slices, spread, tokenizer_path

#: The end-of-document id of the vocabulary; texts are encoded literally, so none holds it.
END_ID = 50256


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Writes one flat file a task below ``path``, rows in their order; (file, place, doc_id) a document.

    Nothing is shuffled. The returned table is kept apart from the files, which have no index.
    """
    end = int(end_id).to_bytes(width, "little")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        name = f"{path}/part-{TaskContext.get().partitionId():06d}.ids"
        encoder, place, numbers = encoder_of(tokenizer, f"<u{width}", literal=True), 0, []
        with created(name) as out:
            for batch in slices(batches, encodes=True):
                for ids in encoder.encode([t or "" for t in batch.column("text").to_pylist()]):
                    out.write(ids + end)
                numbers += batch.column("doc_id").to_pylist()
                if len(numbers) >= 10_000:
                    yield _placed(pa, name, place, numbers)
                    place, numbers = place + len(numbers), []
        if numbers:
            yield _placed(pa, name, place, numbers)

    return persisted(docs.select("doc_id", "text").mapInArrow(run, "file string, place long, doc_id long"), "flat-manifest")


def _placed(pa, name: str, place: int, numbers: list):
    return pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]] * len(numbers), pa.string()), pa.array(range(place, place + len(numbers)), pa.int64()), pa.array(numbers, pa.int64())], names=["file", "place", "doc_id"])


def count(spark: SparkSession, path: str, end_id: int = END_ID, width: int = 2, block_ids: int = 4_000_000) -> DataFrame:
    """(file, place, start, n_tokens, ended) of every document in the flat files below ``path``.

    ``start`` counts ids from the beginning of the file. Blocks are ``block_ids``
    ids, so a task's memory doesn't depend on the size of a file or document.
    """
    files = spark.createDataFrame([(uri, size // width) for uri, size in listed(path, ".ids")], "uri string, n_ids long")
    starts = files.where("n_ids > 0").select("uri", F.explode(F.expr(f"sequence(0L, n_ids - 1, {block_ids}L)")).alias("first"), "n_ids")
    blocks = spread(starts.select("uri", "first", F.least(F.lit(block_ids).cast("long"), F.col("n_ids") - F.col("first")).alias("n")))

    def search(batches):
        import pyarrow as pa

        for batch in batches:
            for uri, first, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = np.frombuffer(read_range(uri, first * width, n * width), f"<u{width}")
                ends = np.flatnonzero(ids == end_id) + first
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri.rpartition("/")[2]]), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                    names=["file", "first", "n", "n_ends", "last_end", "ends"],
                )

    found = persisted(blocks.mapInArrow(search, "file string, first long, n long, n_ends long, last_end long, ends array<long>"), "flat-blocks")
    before = W.partitionBy("file").orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    # The scan runs over summaries, a few numbers a block; the places of the ends join it afterwards.
    scanned = found.select(
        "file",
        "first",
        (F.coalesce(F.last("last_end", ignorenulls=True).over(before), F.lit(-1)) + 1).alias("open_from"),
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("place_from"),
        F.lead("first").over(W.partitionBy("file").orderBy("first")).isNull().alias("final"),
    )
    joined = found.join(scanned, ["file", "first"])
    tail = F.coalesce(F.col("last_end") + 1, F.col("open_from"))
    stop = F.col("first") + F.col("n")
    rest = F.when(F.col("final") & (tail < stop), F.array(F.struct(F.col("n_ends").alias("i"), tail.alias("start"), (stop - tail).alias("n_tokens"), F.lit(False).alias("ended"))))
    ended = F.transform("ends", lambda e, i: F.struct(i.cast("long").alias("i"), F.when(i == 0, F.col("open_from")).otherwise(F.get("ends", i - 1) + 1).alias("start"), (e - F.when(i == 0, F.col("open_from")).otherwise(F.get("ends", i - 1) + 1)).alias("n_tokens"), F.lit(True).alias("ended")))
    documents = joined.select("file", "place_from", F.explode(F.concat(ended, F.coalesce(rest, F.expr("filter(transform(ends, (e, i) -> struct(i * 1L as i, e as start, e as n_tokens, true as ended)), x -> false)")))).alias("d"))
    return documents.select("file", (F.col("place_from") + F.col("d.i")).alias("place"), F.col("d.start").alias("start"), F.col("d.n_tokens").alias("n_tokens"), F.col("d.ended").alias("ended"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its file, its place and start there, its tokens without the end id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = new_path(spark, "flat")
    manifest = write(docs, path, tokenizer_path())
    return manifest.join(count(spark, path), ["file", "place"]).select("doc_id", "n_tokens", "file", "place", "start")
