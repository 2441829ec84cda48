"""Best-fit packing of token sequences, improved by swap-based local search.

``pieces`` encodes documents and cuts only those longer than a sequence. ``pack``
deals pieces at random into groups of bounded size, and each group is packed on
its own: best fit in decreasing order, then moves, one-for-one and two-for-one
exchanges between underfull sequences, each of which increases the sum of squared
fills, from the lightest sequence on, until the bound is met or no exchange helps.
Sequences are indexed by room and by the lengths they hold, so an exchange scans none.

Edge cases: a null text is an empty one, whose only token is the end id; repeated
rows are separate documents; a document of any length is cut into as many pieces
as it needs; an empty table gives no pieces. ``pieces`` reads ``doc_id`` and
``text`` alone; ``pack`` carries other columns along and refuses a clash with its own.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import REMEMBER, persisted, slices, tokenizer_path, without
from ._shared import encoder as encoder_of

CAPACITY = 2048
#: Pieces packed together: a bound on the memory of a task; each group leaves about one sequence underfull.
GROUP = 65_536


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first takes what whole sequences leave."""
    n = max(1, -(-total // capacity))
    first = total - (n - 1) * capacity
    return [(0, first), *((first + i * capacity, capacity) for i in range(n - 1))]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, remember: int = REMEMBER) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document; ids as unsigned 32-bit binary.

    A special token spelt out in a text is encoded to its id, as the library does by itself.
    ``remember`` bounds the encoded pieces that a Python process keeps, memory against time.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        import pyarrow as pa

        encoder = encoder_of(tokenizer, "<u4", remember)
        for batch in slices(batches, 2_000_000, encodes=True):
            rows: list[tuple] = []
            encoded = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            for number, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                ids += end
                rows += [(number, i, a, n, ids[4 * a : 4 * (a + n)]) for i, (a, n) in enumerate(cut(len(ids) // 4, capacity))]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


class Bins:
    """Sequences of one group while they are packed."""

    def __init__(self, lengths: np.ndarray, capacity: int = CAPACITY):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each where least room stays."""
        open_: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        some = 0  # bit r: a bin has r tokens of room
        for i in np.argsort(-self.lengths, kind="stable").tolist():
            n = int(self.lengths[i])
            fits = some >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                b = open_[room].pop()
                if not open_[room]:
                    some ^= 1 << room
            else:
                b, room = len(self.bins), self.capacity
                self.bins.append([])
                self.free.append(room)
            self.bins[b].append(i)
            room -= n
            self.free[b] = room
            if room:
                open_[room].append(b)
                some |= 1 << room

    def search(self) -> None:
        """Empties light bins, lightest first; ends at the lower bound, or when no exchange out of any bin helps."""
        least = math.ceil(int(self.lengths.sum()) / self.capacity)
        alive = sum(1 for b in self.bins if b)
        if alive <= least:
            return
        self.rooms: dict[int, _Room] = {}
        for b, own in enumerate(self.bins):
            if own and self.free[b]:
                self._enter(b)
        some = True
        while some and alive > least:
            some = False
            # Bins to try, by room; an exchange puts both of its bins back.
            todo: dict[int, dict[int, None]] = {r: dict.fromkeys(room.bins) for r, room in self.rooms.items()}
            heap = [-r for r in todo]
            heapq.heapify(heap)
            while heap and alive > least:
                r = -heap[0]
                if not todo.get(r):
                    heapq.heappop(heap)
                    continue
                d = next(iter(todo[r]))
                del todo[r][d]
                if not self.bins[d] or self.free[d] != r:
                    continue
                b = self._improve(d)
                if b is None:
                    continue
                some = True
                alive -= not self.bins[d]
                for x in (d, b):
                    if self.bins[x] and self.free[x]:
                        if not todo.get(self.free[x]):
                            heapq.heappush(heap, -self.free[x])
                        todo.setdefault(self.free[x], {})[x] = None
        del self.rooms

    def _sums(self, b: int) -> tuple[dict[int, tuple[int, ...]], dict[int, tuple[int, ...]]]:
        """Lengths of single pieces of a bin, and of pairs, each with the pieces of one such choice."""
        by: dict[int, list[int]] = {}
        for p in self.bins[b]:
            by.setdefault(int(self.lengths[p]), []).append(p)
        singles = {n: (own[0],) for n, own in by.items()}
        sizes = list(by)
        pairs = {2 * n: (own[0], own[1]) for n, own in by.items() if len(own) > 1}
        for k, n in enumerate(sizes):
            for m in sizes[k + 1 :]:
                pairs[n + m] = (by[n][0], by[m][0])
        return singles, pairs

    def _enter(self, b: int) -> None:
        if self.free[b] not in self.rooms:
            self.rooms[self.free[b]] = _Room()
        self.rooms[self.free[b]].add(b, *self._sums(b))

    def _leave(self, b: int) -> None:
        room = self.rooms[self.free[b]]
        room.drop(b, *self._sums(b))
        if not room.bins:
            del self.rooms[self.free[b]]

    def _improve(self, d: int) -> int | None:
        """Makes the exchange out of bin ``d`` that moves most tokens to a bin at least as full; that bin, if there is one."""
        self._leave(d)
        singles, pairs = self._sums(d)
        ways = ((singles, sum(1 << n for n in singles)), (pairs, sum(1 << n for n in pairs)))
        gain, best = 0, None
        for r in sorted((r for r in self.rooms if r <= self.free[d]), reverse=True):
            if r <= gain:
                break  # no exchange moves more than the room
            room = self.rooms[r]
            # What comes back: nothing, a piece, or (for one piece) two pieces of the same bin.
            for gone, (some, bits) in enumerate(ways):
                came = 1 | room.ones | (0 if gone else room.twos)
                found = _most(some, bits, came, gain, r)
                if found:
                    gain, best = found, (r, gone, bits & came << found)
        if best is None:
            self._enter(d)
            return None
        r, gone, common = best
        total = (common & -common).bit_length() - 1
        room, size = self.rooms[r], total - gain
        b = next(iter(room.bins if not size else room.one.get(size) or room.two[size]))
        own = self._sums(b)
        back = () if not size else own[0].get(size) or own[1][size]
        self._leave(b)
        away = ways[gone][0][total]
        self.bins[d] = [p for p in self.bins[d] if p not in away] + list(back)
        self.bins[b] = [p for p in self.bins[b] if p not in back] + list(away)
        self.free[d] += gain
        self.free[b] -= gain
        for x in (d, b):
            if self.bins[x] and self.free[x]:
                self._enter(x)
        return b


class _Room:
    """The bins with one amount of room, and which of them hold a piece, or two, of some length together."""

    def __init__(self):
        self.bins: dict[int, None] = {}
        self.one: dict[int, dict[int, None]] = {}
        self.two: dict[int, dict[int, None]] = {}
        self.ones = self.twos = 0  # bit n: length n occurs

    def add(self, b: int, singles, pairs) -> None:
        self.bins[b] = None
        for n in singles:
            self.one.setdefault(n, {})[b] = None
            self.ones |= 1 << n
        for n in pairs:
            self.two.setdefault(n, {})[b] = None
            self.twos |= 1 << n

    def drop(self, b: int, singles, pairs) -> None:
        del self.bins[b]
        for n in singles:
            del self.one[n][b]
            if not self.one[n]:
                del self.one[n]
                self.ones ^= 1 << n
        for n in pairs:
            del self.two[n][b]
            if not self.two[n]:
                del self.two[n]
                self.twos ^= 1 << n


def _most(some, bits: int, came: int, least: int, most: int) -> int:
    """The greatest difference over ``least``, at most ``most``, of a length in ``some`` (``bits``) and one in ``came``; or 0."""
    if len(some) > most - least:
        return next((g for g in range(most, least, -1) if bits & came << g), 0)
    best = least
    for total in some:
        if total > best:
            low = max(0, total - most)
            fits = came >> low
            if fits and (g := total - low - (fits & -fits).bit_length() + 1) > best:
                best = g
    return best if best > least else 0


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``parts`` (length, anything else) with ``sequence_id`` and ``offset``; each length is 1 to ``capacity``.

    The input is kept as a table first, so the random deal into groups is the same
    whenever a task runs again, and no group depends on a key of the data.
    """
    without(parts, "sequence_id", "offset", "_group")
    table = persisted(parts, "pieces")
    groups = max(1, math.ceil(table.count() / group))
    dealt = table.withColumn("_group", F.floor(F.rand(0) * groups).cast("long"))
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batch):
        import pyarrow as pa

        lengths = batch.column("length").to_numpy().astype(np.int64)
        bins = Bins(lengths, capacity)
        bins.best_fit()
        bins.search()
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        base = batch.column("_group")[0].as_py() << 32 if len(lengths) else 0
        for b, own in enumerate(bins.bins):
            at = 0
            for i in own:
                sequence[i], offset[i] = base + b, at
                at += int(lengths[i])
        return batch.drop_columns(["_group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("_group").applyInArrow(run, schema)


def packed(docs: DataFrame, remember: int = REMEMBER) -> DataFrame:
    """The placed pieces of documents, with a checksum in place of the ids."""
    cut_up = pieces(docs, tokenizer_path(), remember=remember).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(cut_up)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece: its document, place in it, checksum of its ids, sequence and offset."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
