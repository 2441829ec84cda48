"""Token ids in binary shards whose document boundaries are Elias-Fano encoded.

A shard holds the ids of its documents in one array, and two monotone sequences
as Elias-Fano codes: the ends of the documents in that array, and the document
numbers. ``Sequence.select(i)`` finds the i-th value from sampled positions of the
upper bits, ``selected`` a stretch of values, so offsets need about two bits a
document more than the information they hold, and no table of 64-bit offsets. Reading
selects the bounds of the documents that are wanted; no sequence is decoded whole.

Shard file, all numbers little-endian: magic ``KLEF0001``; unsigned 64-bit: ids,
documents, documents without a number, bytes an id takes, the first number
(signed); the ids; the two codes. A code: unsigned 64-bit count, largest value,
low bits each; the low bits, packed; the upper bits; unsigned 32-bit positions of
every 256th set upper bit. Each part is padded to 8 bytes.

Edge cases: a null text is an empty one, so its document is the end id alone; a
null document number sorts first and comes back as null; equal numbers stay
separate documents, in order of a hash of their text; an empty table gives no
shard and no rows. Texts are encoded whole, whatever their length; a special token
spelt out in a text becomes its id, as the library does by itself. Other input
columns are ignored.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._files import created, listed, read_all
from ._shared import encoder as encoder_of
from ._shared import new_path, persisted, slices, spread, tokenizer_path

MAGIC = b"KLEF0001"
EVERY = 256
_CHUNK = 1 << 16  # rows packed at once; a multiple of 8, so chunks end on whole bytes


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


def _pack(values: np.ndarray, bits: int) -> bytes:
    out = []
    for at in range(0, len(values) if bits else 0, _CHUNK):
        some = np.ascontiguousarray(values[at : at + _CHUNK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        out.append(np.packbits(np.unpackbits(some, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes())
    return b"".join(out)


def _unpack(data: np.ndarray, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` values of ``bits`` bits from the ``start``-th on."""
    if not bits:
        return np.zeros(count, np.uint64)
    out = np.empty(count, np.uint64)
    for at in range(0, count, _CHUNK):
        n = min(_CHUNK, count - at)
        first = (start + at) * bits
        piece = np.unpackbits(data[first // 8 : (first + n * bits + 7) // 8], bitorder="little")[first % 8 :][: n * bits].reshape(n, bits)
        wide = np.zeros((n, 64), np.uint8)
        wide[:, :bits] = piece
        out[at : at + n] = np.packbits(wide, axis=1, bitorder="little").view("<u8").ravel()
    return out


@dataclass
class Sequence:
    """A non-decreasing sequence of whole numbers as an Elias-Fano code."""

    count: int
    most: int
    bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> Sequence:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        most = int(values[-1]) if n else 0
        bits = max(0, (most // n).bit_length() - 1) if n else 0
        upper = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros((int(upper[-1]) if n else 0) + 1, np.uint8)
        flags[upper] = 1
        return cls(n, most, bits, np.frombuffer(_pack(values, bits), np.uint8), np.packbits(flags, bitorder="little"), upper[::EVERY].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQQQQ", self.count, self.most, self.bits, len(self.low), len(self.high))
        return head + b"".join(_padded(x.tobytes()) for x in (self.low, self.high, self.samples))

    @classmethod
    def from_bytes(cls, data: memoryview, at: int) -> tuple[Sequence, int]:
        count, most, bits, n_low, n_high = struct.unpack_from("<QQQQQ", data, at)
        at += 40
        parts = []
        for length, kind in ((n_low, np.uint8), (n_high, np.uint8), (4 * -(-count // EVERY), "<u4")):
            parts.append(np.frombuffer(data[at : at + length], kind))
            at += length + -length % 8
        return cls(count, most, bits, *parts), at

    def select(self, i: int) -> int:
        """The i-th value."""
        return int(self.selected(i, 1)[0])

    def selected(self, first: int, count: int) -> np.ndarray:
        """``count`` values from the ``first``-th on, found from the sampled bits around them; no other is decoded.

        The upper bits between the sample at or before the first value and the sample
        after the last hold all that is wanted; set bits before the first are skipped.
        """
        if not 0 <= first <= first + count <= self.count:
            raise IndexError(first)
        if not count:
            return np.empty(0, np.uint64)
        start, after = int(self.samples[first // EVERY]), (first + count - 1) // EVERY + 1
        stop = int(self.samples[after]) if after < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :]
        place = np.flatnonzero(bits)[first % EVERY :][:count] + start
        upper = place - np.arange(first, first + count)
        return (upper.astype(np.uint64) << np.uint64(self.bits)) | _unpack(self.low, self.bits, first, count)


def shard_bytes(numbers: list[int | None], encoded: list[bytes], width: int) -> bytes:
    """One shard: ``encoded`` are the packed ids of each document, ``numbers`` ascending with nulls first."""
    sizes = np.fromiter((len(e) for e in encoded), np.int64, len(encoded)) // width
    nulls = sum(n is None for n in numbers)
    first = numbers[nulls] if nulls < len(numbers) else 0
    gaps = np.fromiter((n - first for n in numbers[nulls:]), np.uint64, len(numbers) - nulls)
    head = MAGIC + struct.pack("<QQQQq", int(sizes.sum()), len(encoded), nulls, width, first)
    return head + _padded(b"".join(encoded)) + Sequence.of(np.cumsum(sizes)).to_bytes() + Sequence.of(gaps).to_bytes()


class Shard:
    """A shard read back: ids of any document by its place, without decoding the others."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard")
        view = memoryview(data)
        self.n_ids, self.n_docs, self._nulls, width, self._first = struct.unpack_from("<QQQQq", data, 8)
        size = self.n_ids * width
        self.ids = np.frombuffer(view[48 : 48 + size], f"<u{width}")
        self.ends, at = Sequence.from_bytes(view, 48 + size + -size % 8)
        self._numbers, _ = Sequence.from_bytes(view, at)

    def document(self, i: int) -> np.ndarray:
        start, end = self.bounds(i, 1).tolist()
        return self.ids[start:end]

    def bounds(self, first: int, count: int) -> np.ndarray:
        """Where ``count`` documents from the ``first``-th on begin, and where the last of them ends."""
        before = int(first > 0)
        found = self.ends.selected(first - before, count + before).astype(np.int64)
        return found if before else np.concatenate([[0], found])

    def numbers(self, first: int, count: int) -> list[int | None]:
        """The numbers of ``count`` documents from the ``first``-th on."""
        nulls = min(count, max(0, self._nulls - first))
        known = self._numbers.selected(first + nulls - self._nulls, count - nulls) if count > nulls else ()
        return [None] * nulls + [self._first + int(g) for g in known]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, width: int = 2, shard_ids: int = 4_000_000) -> DataFrame:
    """Writes shards below ``path`` in ascending document order; one row a shard, kept in the shared folder.

    Rows are dealt by ranges of (number, hash of the text, a random salt), so even one
    number on a third of all rows spreads over tasks. The texts move once, before they
    are encoded; no task holds more than one shard and one Arrow batch. A task that
    runs again writes the same shards under the same names.
    """
    salted = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("salt", F.rand(0))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("salt")]
    ordered = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    end = int(end_id).to_bytes(width, "little")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = encoder_of(tokenizer, f"<u{width}")
        kept: list[tuple[int | None, bytes]] = []
        held, seq = 0, 0

        def flush():
            nonlocal kept, held, seq
            name = f"{path}/part-{part:06d}-{seq:06d}.klef"
            with created(name) as out:
                out.write(shard_bytes([n for n, _ in kept], [e for _, e in kept], width))
            row = {"part": part, "seq": seq, "path": name, "n_docs": len(kept), "n_ids": held}
            kept, held, seq = [], 0, seq + 1
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in slices(batches, encodes=True):
            encoded = encoder.encode(batch.column("text").to_pylist())
            for number, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                size = len(ids) // width + 1
                if kept and held + size > shard_ids:
                    yield flush()
                kept.append((number, ids + end))
                held += size
        if kept:
            yield flush()

    return persisted(ordered.mapInArrow(run, "part int, seq int, path string, n_docs long, n_ids long"), "shards")


def read(shards: DataFrame) -> DataFrame:
    """One row a document of the shards: number, ids before it in all shards, ids, as unsigned 32-bit binary."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row a task of the writing job, then rows of one task: both windows stay small.
    base = parts.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    within = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = shards.withColumn("within", within).join(base, F.col("part") == F.col("of"))
    todo = spread(placed.select("path", (F.col("part_start") + F.col("within")).cast("long").alias("base")))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(read_all(path))
                for at in range(0, shard.n_docs, 2000):
                    count = min(2000, shard.n_docs - at)
                    bounds = shard.bounds(at, count)
                    ids = [shard.ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.numbers(at, count), pa.int64()), pa.array(bounds[:-1] + start, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])

    return todo.mapInArrow(run, "doc_id long, start long, ids binary")


def shards_below(spark: SparkSession, path: str) -> DataFrame:
    """The shard table of a folder, from the files alone."""
    rows = []
    for name, _ in listed(path, ".klef"):
        part, seq = name.rpartition("/")[2][5:-5].split("-")
        head = struct.unpack_from("<QQ", _head(name), 8)
        rows.append((int(part), int(seq), name, head[1], head[0]))
    return spark.createDataFrame(rows, "part int, seq int, path string, n_docs long, n_ids long")


def _head(uri: str) -> bytes:
    from ._files import read_range

    return read_range(uri, 0, 48)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, from the files read back: ids before it, its ids with the end id, their crc32."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = write(docs, new_path(spark, "klef"), tokenizer_path())
    return read(shards).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
