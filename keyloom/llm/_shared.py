"""Helpers that several operators of this subpackage use.

Everything that executors and driver exchange through files goes below the
folder named by ``spark.checkpoint.dir``; a machine-local folder is chosen only
for a local master that names none.
"""

from __future__ import annotations

import atexit
import itertools
import tempfile
import threading
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP_SQL = r"[\\x20\\x09-\\x0D]+"

#: Marks that end a word and join no other id; an apostrophe may, so it isn't here.
_MARKS = frozenset(".,;:!?")

#: Pieces that an encoder remembers, some 150 bytes each.
REMEMBER = 1_300_000

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a fresh temporary one on a local master without one."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="keyloom-")
    return _local_dirs[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/keyloom/{uuid.uuid4().hex}-{name}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may have ended already; the folder is the cluster's to clean
        return


def persisted(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, so a lost executor costs no rework.

    ``file_rows`` bounds the rows of a file, if given.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    _tables[path] = (next(_numbers), threading.get_ident(), spark)
    return out


#: Tables made by ``persisted`` and not yet deleted: number, thread and session.
_tables: dict[str, tuple[int, int, SparkSession]] = {}
_numbers = itertools.count()


def table_path(df: DataFrame) -> str | None:
    """Where ``persisted`` keeps a table; none for any other frame."""
    return getattr(df, "_table_path", None)


def made() -> int:
    """A mark for ``swept``: tables made from now on come after it."""
    return next(_numbers)


def swept(mark: int, *kept: DataFrame) -> None:
    """Deletes the tables that this thread made since ``mark``, but for ``kept``; whatever reads the others must have run."""
    keep = {table_path(df) for df in kept}
    for path, (number, thread, spark) in list(_tables.items()):
        if number > mark and thread == threading.get_ident() and path not in keep:
            del _tables[path]
            _remove(spark, path)


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], small: bool, spread_by: list[str], salts: int = 64) -> DataFrame:
    """``rows`` joined with their row of ``table``, which has one a key: by broadcast if it is ``small``, else salted.

    Salting deals the rows of one key to ``salts`` tasks by a hash of the columns
    ``spread_by``, and takes as many copies of the table.
    """
    if small:
        return rows.join(F.broadcast(table), keys)
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts))).join(copies, [*keys, "_salt"]).drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """Rows that stand for much work each, dealt to as many tasks as there are, at most four a core or shuffle partition."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(df.count(), 4 * max(cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))


def words(text: Column) -> Column:
    """The words of a text, in order; null gives an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def without(df: DataFrame, *names: str) -> None:
    """Refuses input whose columns would clash with working columns of an operator."""
    clash = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if clash:
        raise ValueError(f"input has reserved columns {sorted(clash)}")


@lru_cache(maxsize=1)
def _byte_chars() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: visible Latin-1 characters as they are, others from U+0100 on."""
    visible = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def _byte_set(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for first, last in spans:
        out[first : last + 1] = True
    return out


#: White space of one byte; bytes that begin characters some of which are white space, of two bytes and of three.
_WHITE, _LEAD2, _LEAD3 = _byte_set((9, 13), (28, 32)), _byte_set((0xC2, 0xC2)), _byte_set((0xE1, 0xE3))
_NOT_AFTER = _WHITE | _LEAD2 | _LEAD3


class WordEncoder:
    """Encodes whole texts with a tokenizers file, once for each distinct piece.

    The pattern of the byte-level vocabulary never matches across a single space
    that stands between two characters that aren't white space (the space goes with
    what follows), and takes a single line end there as an id of its own. So a text
    may be cut at both: ids of the pieces concatenate to the ids of the text. Beside
    characters that could be white space beyond ASCII nothing is cut; other white space
    stays inside pieces. Arrow numbers the distinct pieces of a batch, so Python
    meets each once; those met lately are kept in two generations, so that
    frequent ones stay.

    A special token spelt out in a text gets its id, as the library does by itself;
    ``literal`` encodes its characters like any others.
    """

    def __init__(self, path: str, dtype: str = "<u4", most: int = REMEMBER, literal: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = literal
        self._dtype, self._code = dtype, {"<u2": "H", "<u4": "I"}[dtype]
        self._most = most
        self._known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    def _learn(self, pieces: list[bytes]) -> None:
        """Encodes pieces that aren't known. Most are letters, maybe with one mark after them; a mark is always an id of its own."""
        known, odd, ended = self._known, [], []
        tokenize, code, chars = self._tokenizer.model.tokenize, self._code, _byte_chars()

        def letters(piece: bytes, text: str) -> None:
            # What the pattern would leave whole goes to the model at once.
            spelt = text if len(text) == len(piece) else piece.decode("latin-1").translate(chars)
            known[piece] = array(code, [x.id for x in tokenize("\u0120" + spelt[1:] if spelt[0] == " " else spelt)]).tobytes()

        for piece in pieces:
            text = piece.decode()
            body = text[1:] if text[0] == " " else text
            if body.isalpha():
                letters(piece, text)
            elif body[-1:] in _MARKS and body[:-1].isalpha():
                if piece[:-1] not in known:
                    letters(piece[:-1], text[:-1])
                ended.append(piece)
            else:
                odd.append(piece)
        marks = {p[-1:] for p in ended} - known.keys()
        odd += marks - set(odd)
        for at in range(0, len(odd), 4096):
            some = odd[at : at + 4096]
            for piece, made in zip(some, self._tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False), strict=True):
                known[piece] = array(code, made.ids).tobytes()
        for piece in ended:
            known[piece] = known[piece[:-1]] + known[piece[-1:]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed little-endian numbers."""
        out: list[bytes] = []
        batch: list[bytes] = []
        size = 0
        for i, text in enumerate(texts):
            batch.append(text.encode())
            size += len(batch[-1])
            if size > min(8_000_000, 6 * self._most) or i == len(texts) - 1:
                out += self._encode(batch)
                batch, size = [], 0
        return out

    def _encode(self, batch: list[bytes]) -> list[bytes]:
        import pyarrow as pa

        joined = b"".join(batch)
        if not joined:
            return [b""] * len(batch)
        data, ends = np.frombuffer(joined, np.uint8), np.cumsum([len(b) for b in batch])
        # Where pieces begin: at texts, at spaces to cut at, and at and after line ends to cut at.
        begins = np.zeros(len(data) + 1, bool)
        begins[0] = True
        begins[ends] = True
        at = np.flatnonzero((data == 32) | (data == 10))
        at = at[~begins[at] & ~begins[at + 1]]
        at = at[~(_WHITE[data[at - 1]] | _LEAD2[data[at - 2]] | _LEAD3[data[at - 3]] | _NOT_AFTER[data[at + 1]])]
        begins[at] = True
        begins[at[data[at] == 10] + 1] = True
        bounds = np.flatnonzero(begins[:-1])
        offsets = np.append(bounds, len(data)).astype(np.int64)
        numbered = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        place, (_, cuts, distinct) = numbered.indices.to_numpy(), numbered.dictionary.buffers()
        raw, cuts = distinct.to_pybytes(), np.frombuffer(cuts, np.int64)[: len(numbered.dictionary) + 1].tolist()
        pieces = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

        if len(self._known) * 2 > self._most:
            self._known, self._older = {}, self._known
        known, older = self._known, self._older
        new = [p for p in pieces if p not in known]
        if older:
            for p in new:
                if p in older:
                    known[p] = older[p]
            new = [p for p in new if p not in known]
        self._learn(new)
        made = [known[p] for p in pieces]

        width = np.dtype(self._dtype).itemsize
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // width
        first, ids = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(made), self._dtype)
        count = sizes[place]
        upto = np.concatenate([[0], np.cumsum(count)])
        out = ids[np.repeat(first[place] - upto[:-1], count) + np.arange(upto[-1])].tobytes()
        stops = (upto[np.searchsorted(bounds, ends)] * width).tolist()
        return [out[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str, dtype: str, most: int = REMEMBER, literal: bool = False) -> WordEncoder:
    """The encoder of this process: pieces met in one task are known in the next."""
    return WordEncoder(path, dtype, most, literal)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batches: Iterator, most_bytes: int = 8_000_000, encodes: bool = False) -> Iterator:
    """Arrow batches cut to about ``most_bytes``, a single longer row alone.

    A task that encodes nothing first drops what earlier tasks of its process kept to
    encode with, and every task hands unused memory back when it ends.
    """
    if not encodes:
        encoder.cache_clear()
    give_back()
    try:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            step = max(1, min(rows, rows * most_bytes // max(1, batch.nbytes)))
            for at in range(0, rows, step):
                yield batch.slice(at, step)
    finally:
        give_back()


def give_back() -> None:
    """Returns memory that nothing uses to the system, where the allocators allow it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
