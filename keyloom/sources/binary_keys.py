"""Binary key files: a 64-bit count, then as many unsigned keys of four or eight bytes, little-endian."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class KeyRange(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class KeyReader(DataSourceReader):
    """Reads ranges of one file side by side."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.width = int(options.get("width", 8))
        self.each = int(options.get("keysPerPartition", 4_000_000))
        self.missing_ok = options.get("missing", "fail") == "empty"

    def _open(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + os.path.abspath(self.path))
        return store.open_input_file(path)

    def partitions(self):
        try:
            with self._open() as file:
                count = int.from_bytes(file.read(8), "little")
        except FileNotFoundError:
            if self.missing_ok:
                return [KeyRange(self.path, 0, 0)]
            raise
        return [KeyRange(self.path, at, min(self.each, count - at)) for at in range(0, count, self.each)] or [KeyRange(self.path, 0, 0)]

    def read(self, partition: KeyRange):
        import numpy as np
        import pyarrow as pa

        if not partition.count:
            return
        with self._open() as file:
            data = file.read_at(partition.count * self.width, 8 + partition.first * self.width)
        keys = np.frombuffer(data, f"<u{self.width}")
        if len(keys) < partition.count:
            raise ValueError(f"{partition.path} is shorter than its count says")
        for at in range(0, len(keys), 100_000):
            some = keys[at : at + 100_000]
            # A decimal is a little-endian 128-bit number: the key, then zeros.
            wide = np.zeros((len(some), 2), "<u8")
            wide[:, 0] = some
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.decimal128(20, 0), len(some), [None, pa.py_buffer(wide.tobytes())])], names=["key"])


class BinaryKeys(DataSource):
    """``spark.read.format("binary_keys")``; options path, width, keysPerPartition, missing (fail or empty)."""

    @classmethod
    def name(cls) -> str:
        return "binary_keys"

    def schema(self) -> str:
        return "key decimal(20,0)"

    def reader(self, schema) -> KeyReader:
        return KeyReader(self.options)


def read_keys(spark: SparkSession, path: str, width: int = 8, dedupe: bool = True, unsigned: bool = False, missing: str = "fail") -> DataFrame:
    """(key) of a binary file: distinct and in order if ``dedupe``; as a long unless ``unsigned`` asks for the full range."""
    spark.dataSource.register(BinaryKeys)
    keys = spark.read.format("binary_keys").option("width", width).option("missing", missing).load(path)
    if not unsigned:
        keys = keys.select(F.col("key").cast("long").alias("key"))
    return keys.distinct().orderBy("key") if dedupe else keys


def write_keys(keys: DataFrame, path: str, width: int = 8) -> None:
    """Writes a key set to one local file, in order: executors pack the keys, the driver appends a batch at a time."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            # As above: the lower half of each decimal.
            low = np.frombuffer(batch.column(0).buffers()[1], "<u8")[2 * batch.column(0).offset :][: 2 * batch.num_rows : 2]
            yield pa.RecordBatch.from_arrays([pa.array([low.astype(f"<u{width}").tobytes()], pa.binary())], names=["packed"])

    ordered = keys.select(F.col("key").cast("decimal(20,0)").alias("key")).where("key is not null").orderBy("key").persist()
    with open(path, "wb") as out:
        out.write(ordered.count().to_bytes(8, "little"))
        for row in ordered.mapInArrow(pack, "packed binary").toLocalIterator():
            out.write(row.packed)
    ordered.unpersist()
