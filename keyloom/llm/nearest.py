"""Nearest neighbours by score-aware quantisation and exact reranking.

Vectors are scaled to length one, so the largest inner product is the largest
cosine. ``fit`` learns, on a bounded sample, sixteen centroids for each pair of
dimensions; codes and centroids minimise an anisotropic loss, in which residual
error parallel to the vector, which changes the highest inner products, weighs more
than error at right angles to it. ``index`` codes every row, half a byte a pair, and
orders the rows by the nearest of some coarse centres, in files of bounded size.

``search`` is one job that deals pairs of an index file and some files of queries to
tasks. Each query brings a floor, the cosine of its k-th nearest in the sample. A
block of rows is skipped by the queries whose floor, or k-th best so far, is out of
reach for all its rows, by the angles to their centres; so the scan grows less than
with the square of the table as far as the vectors form groups, and stays exact
either way. For the others byte-sized table entries are summed over the codes, the
best of the block are reranked by the exact cosine, and then every other row whose
table sum and residual leave open that its cosine reaches the worst one kept so far,
so no row is lost to equal or nearly equal codes.

Edge cases: vectors that are null, zero, or hold null or non-finite components take
no part, nor do rows without a number or with another number of dimensions than most
of the sample; equal scores go to the smaller number; with too few candidates a
query gets fewer rows; repeated rows are separate candidates; of several query rows
with one number the one with the least vector asks, and none of them is its candidate;
an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._files import listed, open_store
from ._shared import persisted, spread, table_path

PART, CENTROIDS = 2, 16
#: Vectors that the codebooks and coarse centres are learned from, chosen by a hash of their number, and numbers in all of them.
SAMPLE, SAMPLE_NUMBERS = 20_000, 8_000_000
#: Inner products from this cosine on are those whose error counts.
FOCUS = 0.2
#: Candidates that a query reranks first in each block of rows, and the rows of a block.
RERANK, BLOCK = 96, 8_192
#: Slack for rounding in bounds on cosines and on angles, and pairs whose cosines are worked out at once.
SLACK, ANGLE_SLACK, PAIRS = 1e-9, 1e-6, 65_536
#: Queries of a file, those scanned at once in a task, and the files of queries that a task's row names.
QUERIES, AT_ONCE, FILES = 4_096, 256, 16
#: Numbers in the vectors of an index file, which a task holds whole.
FILE_NUMBERS = 4_000_000


@dataclass(frozen=True)
class Codebook:
    """Centroids (parts, 16, 2), the weight of parallel over orthogonal error, coarse centres, and the sample as unit vectors with their numbers."""

    dims: int
    centroids: np.ndarray
    weight: float
    cells: np.ndarray | None = None
    sample: np.ndarray | None = None
    sample_ids: np.ndarray | None = None

    def bare(self) -> Codebook:
        """Without the sample, which only the floors of queries need."""
        return Codebook(self.dims, self.centroids, self.weight, self.cells)

    def split(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors as (rows, parts, 2), padded with zeros."""
        parts = self.centroids.shape[0]
        out = np.zeros((len(x), parts * PART))
        out[:, : self.dims] = x
        return out.reshape(len(x), parts, PART)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows, parts) of unit vectors: nearest centroids, then coordinate descent on the loss."""
        v = self.split(x)
        # Inner products of each part with its centroids, and their plain squared errors.
        dots = np.einsum("npd,pkd->npk", v, self.centroids)
        error = (v**2).sum(2)[:, :, None] - 2 * dots + (self.centroids**2).sum(2)[None]
        code = error.argmin(2)
        own = (v**2).sum(2)
        rows = np.arange(len(x))
        parallel = (own - np.take_along_axis(dots, code[:, :, None], 2)[:, :, 0]).sum(1)
        for _ in range(sweeps):
            for p in range(v.shape[1]):
                rest = parallel - (own[:, p] - dots[rows, p, code[:, p]])
                along = rest[:, None] + own[:, p, None] - dots[:, p]
                code[:, p] = (error[:, p] + (self.weight - 1) * along**2).argmin(1)
                parallel = along[rows, code[:, p]]
        return code.astype(np.uint8)

    def residuals(self, x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residual error of unit vectors along themselves, and its length at right angles to them."""
        v = self.split(x)
        r = v - self.centroids[np.arange(v.shape[1])[None], code]
        along = (r * v).sum((1, 2))
        return along, np.sqrt(((r - along[:, None, None] * v) ** 2).sum((1, 2)))

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte-sized look-up tables (queries, parts, 16); the step of a query, equal for all parts, and what its sums leave out."""
        exact = np.einsum("npd,pkd->npk", self.split(q), self.centroids)
        least = exact.min(2, keepdims=True)
        exact -= least
        step = exact.max(2).max(1) / 255
        step = np.where(step > 0, step, 1)
        return np.round(exact / step[:, None, None]).astype(np.uint8), step, least.sum((1, 2))


def _means(x: np.ndarray, rng: np.random.RandomState, rounds: int = 10) -> np.ndarray:
    centre = x[rng.choice(len(x), CENTROIDS, replace=len(x) < CENTROIDS)].copy()
    for _ in range(rounds):
        near = (((x[:, None] - centre[None]) ** 2).sum(2)).argmin(1)
        for k in range(CENTROIDS):
            if (near == k).any():
                centre[k] = x[near == k].mean(0)
    return centre


def train(x: np.ndarray, rounds: int = 5, seed: int = 0) -> Codebook:
    """Codebooks of unit vectors: means of each part, then codes and centroids in turn on the anisotropic loss."""
    dims = x.shape[1]
    rng = np.random.RandomState(seed)
    weight = max(1.0, (dims - 1) * FOCUS**2 / (1 - FOCUS**2))
    parts = -(-dims // PART)
    book = Codebook(dims, np.zeros((parts, CENTROIDS, PART)), weight)
    v = book.split(x)
    book = Codebook(dims, np.stack([_means(v[:, p], rng) for p in range(parts)]), weight)
    for _ in range(rounds):
        code = book.encode(x).astype(np.int64)
        centroids = book.centroids.copy()
        own = (v**2).sum(2)
        for p in range(parts):
            dots = np.einsum("npd,npd->np", v, centroids[np.arange(parts)[None], code])
            # What the residual along the vector would be with a zero centroid in this part.
            along = (own - dots).sum(1) + dots[:, p]
            for k in range(CENTROIDS):
                mine = code[:, p] == k
                if mine.sum() > PART:
                    y = v[mine, p]
                    left = mine.sum() * np.eye(PART) + (weight - 1) * y.T @ y
                    centroids[p, k] = np.linalg.solve(left, y.sum(0) + (weight - 1) * (along[mine, None] * y).sum(0))
        book = Codebook(dims, centroids, weight)
    return book


def coarse(x: np.ndarray, rounds: int = 6, seed: int = 0) -> np.ndarray:
    """Unit centres of groups of unit vectors, the square root of their number, by means in turn."""
    rng = np.random.RandomState(seed)
    centre = x[rng.choice(len(x), max(1, math.isqrt(len(x))), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(1))
        centre[size > 0] = total[size > 0] / size[size > 0, None]
    return centre


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", e.alias("embedding")).where(finite & F.exists("embedding", lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)  # no overflow of squares
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def fit(vectors: DataFrame, most: int = SAMPLE) -> Codebook | None:
    """A codebook from at most ``most`` usable vectors, fewer if they are long; none if there are no vectors."""
    rows = usable(vectors)
    first = rows.select(F.size("embedding").alias("n")).first()
    if first is None:
        return None
    # The driver gets columns, not rows: SAMPLE_NUMBERS doubles are 64 MB.
    most = max(CENTROIDS, min(most, SAMPLE_NUMBERS // first.n))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toArrow().combine_chunks()
    ids, column = sample.column("vec_id").to_numpy(), sample.column("embedding").combine_chunks()
    sizes = column.value_lengths().to_numpy()
    values, counts = np.unique(sizes, return_counts=True)
    dims = int(values[np.lexsort((values, counts))[-1]])
    kept = np.flatnonzero(sizes == dims)
    x = _unit(_matrix(column.take(kept)))
    book = train(x)
    return Codebook(dims, book.centroids, book.weight, coarse(x), x.astype(np.float32), ids[kept])


def index(vectors: DataFrame, book: Codebook) -> DataFrame:
    """(vec_id, embedding, code, along, across, cell, near) of every usable row, kept in the shared folder.

    along and across come from ``residuals``; cell is the nearest coarse centre and near
    the cosine to it. Rows lie in order of cells; a cell of any size spreads over files.
    """
    spark, book = vectors.sparkSession, book.bare()

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                dots = _unit(_matrix(batch.column("embedding"))) @ book.cells.T
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dots.argmax(1).astype(np.int32)), pa.array(dots.max(1))], names=["vec_id", "embedding", "cell", "near"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column("embedding")))
                code = book.encode(x)
                along, across = book.residuals(x, code)
                if code.shape[1] % 2:
                    code = np.pad(code, ((0, 0), (0, 1)))
                packed = code[:, ::2] | code[:, 1::2] << 4
                vec_id, embedding, cell, near = batch.columns
                yield pa.RecordBatch.from_arrays([vec_id, embedding, pa.array([c.tobytes() for c in packed], pa.binary()), pa.array(along), pa.array(across), cell, near], names=["vec_id", "embedding", "code", "along", "across", "cell", "near"])

    rows = usable(vectors).where(F.size("embedding") == book.dims)
    # The deal by range looks at its input twice, so rows are coded after it.
    placed = rows.mapInArrow(place, "vec_id long, embedding array<double>, cell int, near double")
    tasks = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    file_rows = max(1, min(FILE_NUMBERS // book.dims, max(BLOCK, -(-vectors.count() // tasks))))
    keys = ["cell", F.xxhash64("vec_id")]
    dealt = placed.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    return persisted(dealt.mapInArrow(run, "vec_id long, embedding array<double>, code binary, along double, across double, cell int, near double"), "index", file_rows)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of vectors along the last axis, in double precision, each in the same order of sums."""
    return (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))


def _best(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest whole-number scores of each row, earlier places first on ties."""
    n = scores.shape[1]
    if n <= most:
        return np.broadcast_to(np.arange(n), scores.shape)
    ranked = scores.astype(np.int64) * n + np.arange(n - 1, -1, -1)
    return np.argpartition(-ranked, most - 1, axis=1)[:, :most]


def _merged(score: np.ndarray, number: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((number, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(number, order, 1)


def _reach(worst: np.ndarray, along: np.ndarray, across: np.ndarray) -> np.ndarray:
    """(queries, rows): the least inner product with its coded form of a row whose cosine is ``worst`` or more.

    A unit query at cosine c to a row has inner product c * (1 - along) with its coded
    form, give or take across * sqrt(1 - c * c). The lower end grows with c for c from 0
    and along up to 1; nothing is ruled out otherwise.
    """
    c = np.clip(worst, 0, 1)[:, None]
    low = c * (1 - along)[None] - np.sqrt(1 - c * c) * across[None]
    low[worst < 0] = -np.inf
    low[:, along > 1] = -np.inf
    return low


def _rest(open_: np.ndarray, worst: np.ndarray, queries: np.ndarray, x: np.ndarray, number: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and numbers (queries, k) of the best rows that ``open_`` marks and whose cosine reaches ``worst``, padded."""
    score, found = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
    asked, rows = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
    if not len(asked):
        return score, found
    # Products of matrices round in an order of their own, so they only rule out.
    near = open_[np.ix_(asked, rows)] & (_unit(queries[asked]) @ _unit(x[rows]).T >= worst[asked, None] - SLACK)
    q, r = np.nonzero(near)
    q, r = asked[q], rows[r]
    for at in range(0, len(q), PAIRS):
        i, j = q[at : at + PAIRS], r[at : at + PAIRS]
        exact = cosine(x[j], queries[i])
        order = np.lexsort((number[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        kept = place < k
        mine, new, new_number = np.unique(i), np.full(score.shape, -np.inf), np.full(found.shape, np.iinfo(np.int64).max)
        new[i[kept], place[kept]], new_number[i[kept], place[kept]] = exact[kept], number[j[kept]]
        score[mine], found[mine] = _merged(np.hstack([score[mine], new[mine]]), np.hstack([found[mine], new_number[mine]]), k)
    return score, found


def scan(batches, book: Codebook, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
    """The exact k best of each query among the rows of one task that reach its floor: table scan, then reranking."""
    unit = _unit(queries)
    tables, step, left_out = book.tables(unit)
    angles = np.arccos(np.clip(unit @ book.cells.T, -1, 1))
    best, found = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            cells, radius = _reaches(part.column("cell").to_numpy(), part.column("near").to_numpy())
            # The least angle to any row of the block: that to a centre less what its rows lie off it.
            nearest = np.cos(np.maximum(0, (angles[:, cells] - radius[None]).min(1) - ANGLE_SLACK))
            asked = np.flatnonzero(nearest >= np.maximum(best[:, -1], floor) - SLACK)
            if not len(asked):
                continue
            order = np.argsort(part.column("vec_id").to_numpy(), kind="stable")
            number, x = part.column("vec_id").to_numpy()[order], _matrix(part.column("embedding"))[order]
            packed = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(number), -1)[order]
            along, across = part.column("along").to_numpy()[order], part.column("across").to_numpy()[order]
            for at in range(0, len(asked), AT_ONCE):
                some = asked[at : at + AT_ONCE]
                total = np.zeros((len(some), len(number)), np.int32)
                for p in range(tables.shape[1]):
                    code = packed[:, p // 2] >> 4 if p % 2 else packed[:, p // 2] & 15
                    total += tables[some, p][:, code]
                own = ids[some, None] == number[None]
                total[own] = -1
                top = _best(total, RERANK)
                exact = cosine(x[top], queries[some, None, :])
                exact[np.take_along_axis(total, top, 1) < 0] = -np.inf
                best[some], found[some] = _merged(np.hstack([best[some], exact]), np.hstack([found[some], number[top]]), k)
                if len(number) > RERANK:
                    worst = np.maximum(best[some, -1], floor[some])
                    # Table entries are rounded by half a step at most.
                    most = (total + tables.shape[1] / 2) * step[some, None] + left_out[some, None]
                    open_ = (most >= _reach(worst, along, across) - SLACK) & ~own
                    np.put_along_axis(open_, top, False, 1)
                    more, more_number = _rest(open_, worst, queries[some], x, number, k)
                    best[some], found[some] = _merged(np.hstack([best[some], more]), np.hstack([found[some], more_number]), k)
    return best, found


def _reaches(cell: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of some rows, and the greatest angle of a row to the centre of each."""
    cells, at = np.unique(cell, return_inverse=True)
    least = np.ones(len(cells))
    np.minimum.at(least, at, near)
    return cells, np.arccos(np.clip(least, -1, 1))


def _with_floors(queries: DataFrame, book: Codebook, k: int) -> DataFrame:
    """``queries`` with ``floor``: a lower bound on the cosine of the k-th nearest, from the sample; -2 without one."""
    shared = queries.sparkSession.sparkContext.broadcast((book.sample, book.sample_ids))

    def run(batches):
        import pyarrow as pa

        sample, ids = shared.value
        for batch in batches:
            floors = []
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                score = _unit(_matrix(part.column("embedding"))).astype(np.float32) @ sample.T
                score[part.column("vec_id").to_numpy()[:, None] == ids[None]] = -2
                # Single precision rounds by far less than this.
                floors.append(np.partition(score, -k, axis=1)[:, -k] - 1e-4 if len(ids) >= k else np.full(part.num_rows, -2.0))
            if floors:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(floors).astype(np.float64))], names=["vec_id", "embedding", "floor"])

    return queries.mapInArrow(run, "vec_id long, embedding array<double>, floor double")


def _read(uri: str):
    import pyarrow.parquet as pq

    store, path = open_store(uri)
    return pq.read_table(path, filesystem=store, partitioning=None)


def search(indexed: DataFrame, book: Codebook, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows of each row where ``is_query`` holds.

    Index files and groups of query files are dealt to tasks as pairs, all in one job; a
    task reads both from the shared folder and holds one index file and one file of
    queries. It gives at most ``k`` rows a query, and only those that reach its floor.
    """
    spark = indexed.sparkSession
    if table_path(indexed) is None:
        indexed = persisted(indexed, "index", max(1, FILE_NUMBERS // book.dims))
    asked = indexed.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = persisted(_with_floors(asked, book, k).repartition(1 + asked.count() // QUERIES), "queries", QUERIES)
    rows = [uri for uri, _ in listed(table_path(indexed), ".parquet")]
    blocks = [uri for uri, _ in listed(table_path(asked), ".parquet")]
    files = spark.createDataFrame([(uri,) for uri in rows], "uri string")
    groups = -(-len(blocks) // FILES)
    pairs = files.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))) if groups else files.where("false").withColumn("g", F.lit(0))
    names, bare = spark.sparkContext.broadcast(blocks), book.bare()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for uri, g in zip(batch.column("uri").to_pylist(), batch.column("g").to_pylist(), strict=True):
                part = _read(uri).to_batches()
                for block in names.value[g * FILES : (g + 1) * FILES]:
                    queries = _read(block).combine_chunks()
                    if not queries.num_rows:
                        continue
                    ids, floor = queries.column("vec_id").to_numpy(), queries.column("floor").to_numpy()
                    best, found = scan(part, bare, ids, _matrix(queries.column("embedding").combine_chunks()), floor, k)
                    real = np.isfinite(best) & (best >= floor[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, real.sum(1))), pa.array(found[real]), pa.array(best[real])], names=["query_id", "vec_id", "score"])

    hits = persisted(spread(pairs).mapInArrow(run, "query_id long, vec_id long, score double"), "hits")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector, by cosine."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    book = fit(vectors)
    if book is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index(vectors, book), book, F.col("vec_id") % 50 == 0)
