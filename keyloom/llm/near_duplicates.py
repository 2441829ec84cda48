"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles; texts with a Jaccard similarity of 0.8 or more
are linked. Equal texts form a class and take part once. The steps:

1. one pass signs each text with MinHash values and the bands made of them;
2. classes that share a band meet in buckets. Each is compared with the first of its
   bucket, row by row; those that this leaves apart are compared with all others of the
   bucket, in blocks. MinHash values are compared a few at a time; a pair is dropped
   once the posterior probability that its similarity reaches the threshold falls below
   a tolerance. Survivors join components (a bucket gives a spanning forest, not its
   pairs);
3. inside each component all pairs of classes are verified exactly, on the shingle
   sets; components fall apart where no link holds;
4. documents get the class of their text: the least document number among the texts
   that links connect, and their number of links.

A bucket costs one look a member, whatever its size, unless members stay apart from
its first; these are dealt as pairs of chunks, as components beyond a size are, so that
no task holds more than two chunks and every pair still meets. The tolerance and the bands
together lose about one in 200,000 links at the threshold itself at most, and
practically none above it; step 3 also finds links that step 2 missed within a component.

Edge cases: a text of one to four words is one shingle; texts without words, null
ones too, have no links and classes of their own; null numbers stay null, and name a
class only if all its numbers are null; repeated rows are equal texts; an empty table
gives an empty result. Other columns don't matter; ``dedupe`` keeps them and refuses
names starting with ``_nd_``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import looked_up, made, persisted, slices, swept, without

WORDS = 5
#: The threshold as a fraction, so that verification is exact.
THRESHOLD = (4, 5)
#: So many bands that a pair at the threshold shares none with a probability below the tolerance: (1 - 0.8^5)^35.
BANDS, ROWS = 35, 5
#: Numbers of MinHash values after which a pair may be dropped, and the tolerance.
LOOKS, TOLERANCE = (24, 48, 96, BANDS * ROWS), 1e-6
#: Members of a bucket that make a chunk: so many at least, one in so many parts, and so many at most.
BUCKET_CHUNK = (256, 64, 16_384)
#: Shingles of a component that make a chunk.
SHINGLE_CHUNK = 1_500_000
#: Texts or classes up to this number are looked up by broadcast (some 100 bytes each).
BROADCAST = 150_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.RandomState(20_011)
_A = (_rng.randint(0, 2**62, BANDS * ROWS).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.randint(0, 2**62, BANDS * ROWS).astype(np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    import xxhash

    # bytes.split() splits at space and U+0009 to U+000D, just what separates words.
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    c = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), "<u8")
    n = max(1, len(c) - WORDS + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(c))):
        h = (h ^ c[k : k + n]) * _MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(h: np.ndarray) -> np.ndarray:
    """The MinHash values of a shingle set, 32 bits each."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 2048):
        least = np.minimum(least, (h[at : at + 2048, None] * _A + _B).min(0))
    return (least >> np.uint64(32)).astype(np.uint32)


def _bands(sig: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        h = (h ^ sig.reshape(BANDS, ROWS)[:, k].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest equal values of ``n`` at which a pair stays: uniform prior, values of eight bits.

    The chance that bits agree is s + (1 - s) / 256 for similarity s. Given m matches it
    has a beta posterior, whose tail above the threshold is a binomial sum.
    """
    t = threshold + (1 - threshold) / 256
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n + 1


_NEED = tuple(least_matches(n, THRESHOLD[0] / THRESHOLD[1], TOLERANCE) for n in LOOKS)


def plausible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows of signatures stay after each look; later looks take the rest only."""
    alive = np.arange(len(a))
    matches, seen = np.zeros(len(a), np.int64), 0
    for n, need in zip(LOOKS, _NEED, strict=True):
        matches += (a[alive, seen:n] == b[alive, seen:n]).sum(1)
        keep = matches >= need
        alive, matches, seen = alive[keep], matches[keep], n
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, with the end."""
    n = len(columns[0])
    change = np.zeros(n, bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), n)


def _groups(batches, names: tuple[str, ...]):
    """Arrow batches cut so that rows with equal ``names`` come together, at least one group at a time."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        last = int(_runs(*keys)[-2])
        if held and any(held[-1].column(n)[held[-1].num_rows - 1].as_py() != batch.column(n)[0].as_py() for n in names):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _edges(cid: np.ndarray, sig: np.ndarray, apart: np.ndarray) -> list[tuple[int, int]]:
    """Plausible pairs (places) of members that stay apart with any others; pairs already connected aren't compared.

    A member may occur in both roles; pairs of two that stay apart are taken once.
    """
    _, label = np.unique(cid, return_inverse=True)
    asked = set(cid[apart].tolist())
    both = np.fromiter((c in asked for c in cid.tolist()), bool, len(cid))
    rest = ~apart
    out = []
    for i in np.flatnonzero(apart).tolist():
        other = np.flatnonzero(rest & (label != label[i]) & ~(both & (cid < cid[i])))
        if not len(other):
            continue
        hit = other[plausible(np.broadcast_to(sig[i], (len(other), sig.shape[1])), sig[other])]
        if len(hit):
            joined, at = np.unique(np.append(label[hit], label[i]), return_index=True)
            out += [(i, int(hit[k])) for k in at.tolist() if k < len(hit)]
            label[np.isin(label, joined)] = joined[0]
    return out


def sign(docs: DataFrame) -> DataFrame:
    """(key, doc_id, n, sig, bands) of each document; key: digest of the text, n: shingles."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 2_000_000):
            rows = []
            for number, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h = shingles(text)
                sig = signature(h) if len(h) else None
                rows.append((hashlib.md5((text or "").encode()).digest(), number, len(h), (sig & 255).astype(np.uint8).tobytes() if sig is not None else b"", _bands(sig) if sig is not None else []))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["key", "doc_id", "n", "sig", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "key binary, doc_id long, n long, sig binary, bands array<long>")


def _key() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def candidates(classes: DataFrame) -> DataFrame:
    """Edges (u, v) of spanning forests, over buckets, of pairs that pruning leaves."""
    in_bands = classes.where("n > 0").select("cid", F.posexplode("bands").alias("band", "value")).select("cid", F.xxhash64("band", "value").alias("bucket"))
    # Counting first combines on the map side, so that a bucket of any size costs little.
    shared = in_bands.groupBy("bucket").agg(F.count("*").alias("size"), F.min("cid").alias("first")).where("size > 1")
    met = persisted(in_bands.join(shared, "bucket"), "met")
    sigs = classes.select("cid", "sig")
    # The first of a large group is the first of most of its buckets, so a member meets few of them; each pair is a row of its own.
    pairs = persisted(met.where("cid <> first").select("cid", "first").distinct(), "pairs")
    firsts = persisted(pairs.select("first").distinct(), "firsts")
    few = firsts.count() <= BROADCAST
    first_sigs = sigs.select(F.col("cid").alias("first"), F.col("sig").alias("first_sig")).join(F.broadcast(firsts) if few else firsts, "first")
    todo = looked_up(pairs.join(sigs, "cid"), first_sigs, ["first"], few, ["cid"])

    def look(batches):
        import pyarrow as pa

        for batch in slices(batches):
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, BANDS * ROWS) for c in ("sig", "first_sig"))
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("first"), pa.array(plausible(a, b))], names=["cid", "first", "near"])

    looked = persisted(todo.mapInArrow(look, "cid long, first long, near boolean"), "looked")
    edges = looked.where("near").select(F.col("cid").alias("u"), F.col("first").alias("v"))
    # In a bucket of two there is no other to compare with.
    apart = persisted(met.where("size > 2").join(looked.where("not near").select("cid", "first"), ["cid", "first"]).select("cid", "bucket", "size"), "apart")
    if not apart.limit(1).count():
        return edges
    return edges.unionByName(_among(met, apart, sigs)).distinct()


def _chunks(n: Column) -> Column:
    least, parts, most = BUCKET_CHUNK
    return F.ceil(n / F.least(F.greatest(F.lit(least), n / parts), F.lit(most)))


def _among(met: DataFrame, apart: DataFrame, sigs: DataFrame) -> DataFrame:
    """Edges of the members ``apart`` from the first of their bucket with all other members of it.

    Chunks of either meet as a grid, so a bucket of any size is many tasks; members of a
    bucket without such members go no further.
    """
    many = persisted(apart.groupBy("bucket").agg(F.count("*").alias("n_apart")), "many")
    few = many.count() <= BROADCAST
    zero = F.lit(0).cast("long")
    one = looked_up(apart, many, ["bucket"], few, ["cid"], 8).select("bucket", "cid", F.lit(True).alias("apart"), F.pmod(F.xxhash64("cid"), _chunks(F.col("n_apart"))).alias("p"), F.explode(F.sequence(zero, _chunks(F.col("size")) - 1)).alias("q"))
    # The first itself was compared with all.
    other = looked_up(met.where("cid <> first"), many, ["bucket"], few, ["cid"], 8).select("bucket", "cid", F.lit(False).alias("apart"), F.explode(F.sequence(zero, _chunks(F.col("n_apart")) - 1)).alias("p"), F.pmod(F.xxhash64("cid"), _chunks(F.col("size"))).alias("q"))
    keys = ["bucket", "p", "q"]
    dealt = one.unionByName(other).join(sigs, "cid").repartition(*keys).sortWithinPartitions(*keys, "cid", "apart").select(*keys, "cid", "apart", "sig")

    def run(batches):
        import pyarrow as pa

        for table in _groups(slices(batches), tuple(keys)):
            cid, flag = table.column("cid").to_numpy(), table.column("apart").to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(cid), BANDS * ROWS)
            bounds = _runs(*(table.column(k).to_numpy() for k in keys)).tolist()
            found = [(a + i, a + j) for a, b in zip(bounds[:-1], bounds[1:], strict=True) for i, j in _edges(cid[a:b], sig[a:b], flag[a:b])]
            u, v = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(cid[u]), pa.array(cid[v])], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v): the least node that it is connected to.

    Large and small stars in turn, each an aggregation and a join, with the edges
    kept as a table after every round; rounds grow with the logarithm of the size.
    """
    both = lambda e: e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    state, mark = None, made()
    current = persisted(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while True:
        few = 2 * (current.count() if state is None else state[0]) <= BROADCAST  # no more nodes than ends of edges
        around = both(current)
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # The node in the middle of a large star has as many rows as neighbours.
        large = looked_up(around.where("v > u"), least, ["u"], few, ["v"], 8).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = persisted(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        current = persisted(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
        swept(mark, current)
        now = current.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2**31))), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("v", "u")), F.lit(0))).first()
        if now == state:
            break
        state = now
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


class Incidence:
    """Shingle sets of a few thousand texts, for exact intersections of one with all others.

    Shingles that many texts hold become columns of bits; the rest are lists of their
    texts. Either way a look costs no more than the set and a few words a text.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        values, column = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_inverse=True)
        often = np.bincount(column, minlength=len(values))
        dense = np.flatnonzero(often > max(8, len(sets) // 64))
        number = np.full(len(values), -1)
        number[dense] = np.arange(len(dense))
        self.bits = np.zeros((len(sets), -(-len(dense) // 64) * 8), np.uint8)
        mine = number[column]
        for i, some in zip(*self._split(owner[mine >= 0], mine[mine >= 0]), strict=True):
            self.bits[i] = np.packbits(np.isin(np.arange(self.bits.shape[1] * 8), some, assume_unique=True), bitorder="little")
        self.bits = self.bits.view(np.uint64)
        rare = (mine < 0) & (often[column] > 1)
        order = np.argsort(column[rare], kind="stable")
        self._texts, lists = owner[rare][order], column[rare][order]
        self._from = np.searchsorted(lists, np.arange(len(values)))
        self._to = np.searchsorted(lists, np.arange(len(values)), side="right")
        self._own = dict(zip(*self._split(owner[rare], column[rare]), strict=True))

    @staticmethod
    def _split(owner: np.ndarray, values: np.ndarray):
        bounds = _runs(owner) if len(owner) else np.array([0])
        return owner[bounds[:-1]].tolist(), [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def common(self, i: int) -> np.ndarray:
        """The size of the intersection of text ``i`` with each text."""
        out = np.bitwise_count(self.bits & self.bits[i]).sum(1, dtype=np.int64)
        own = self._own.get(i)
        if own is not None:
            lists = [self._texts[a:b] for a, b in zip(self._from[own].tolist(), self._to[own].tolist(), strict=True)]
            out += np.bincount(np.concatenate(lists), minlength=len(out))
        return out

    def linked(self, i: int) -> np.ndarray:
        """Which texts have at least the threshold's similarity with text ``i``."""
        p, q = THRESHOLD
        common = self.common(i)
        return common * (p + q) >= p * (self.sizes + self.sizes[i])


def verified(members: DataFrame) -> DataFrame:
    """(cid, component, whole, links, root): exact links of each class to documents of other classes.

    ``members`` has cid, component, chunks, n_docs, text, a row a class. ``root`` is
    the least class that links within the task connect; ``whole`` if the task saw the
    whole component.
    """
    split = members.withColumn("c", F.pmod(F.xxhash64("cid"), F.col("chunks"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    keys = ["component", "p", "q"]
    dealt = split.select("component", F.least("c", "o").alias("p"), F.greatest("c", "o").alias("q"), "cid", "c", "chunks", "n_docs", "text").repartition(*keys).sortWithinPartitions(*keys, "cid")

    def run(batches):
        import pyarrow as pa

        for table in _groups(slices(batches, 2_000_000), tuple(keys)):
            bounds = _runs(*(table.column(k).to_numpy() for k in keys))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part = table.slice(a, b - a)
                cid, chunk, n_docs = (part.column(k).to_numpy() for k in ("cid", "c", "n_docs"))
                p, q = part.column("p")[0].as_py(), part.column("q")[0].as_py()
                sets = Incidence([shingles(t) for t in part.column("text").to_pylist()])
                parent, links = np.arange(b - a), np.zeros(b - a, np.int64)
                for i in range(b - a):
                    hit = sets.linked(i)
                    hit[i] = False
                    if p != q:  # pairs within a chunk are another task's
                        hit &= chunk != chunk[i]
                    hit = np.flatnonzero(hit)
                    links[i] = n_docs[hit].sum()
                    for j in hit[hit > i].tolist():
                        x, y = _find(parent, i), _find(parent, j)
                        if x != y:
                            parent[max(x, y)] = min(x, y)
                root = np.array([_find(parent, i) for i in range(b - a)])
                yield pa.RecordBatch.from_arrays([pa.array(cid), part.column("component").combine_chunks(), pa.array(np.full(b - a, part.column("chunks")[0].as_py() == 1)), pa.array(links), pa.array(cid[root])], names=["cid", "component", "whole", "links", "root"])

    return dealt.mapInArrow(run, "cid long, component long, whole boolean, links long, root long")


def classify(docs: DataFrame) -> DataFrame:
    """(key, n_docs, n, cid, label, links, least) a class of equal texts with words.

    label: a class of the same group; links: documents of other classes linked to;
    least: the least document number of the group.
    """
    mark = made()
    agg = sign(docs).groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), *[F.first(c).alias(c) for c in ("n", "sig", "bands")])
    classes = persisted(agg.withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = persisted(components(candidates(classes)), "found")
    swept(mark, classes, found)
    sized = found.join(classes.select(F.col("cid").alias("node"), "key", "n", "n_docs"), "node")
    weights = sized.groupBy("component").agg(F.ceil(F.sum("n") / SHINGLE_CHUNK).alias("chunks"))
    members = persisted(sized.join(weights, "component").select(F.col("node").alias("cid"), "component", "chunks", "n_docs", "key"), "members")
    wanted = members if members.count() > BROADCAST else F.broadcast(members)
    # One text a class: the aggregation combines copies before it moves them.
    texts = docs.select(_key().alias("key"), "text").join(wanted, "key").groupBy("cid", "component", "chunks", "n_docs").agg(F.first("text").alias("text"))
    seen = persisted(verified(texts), "links")
    links = seen.groupBy("cid").agg(F.sum("links").alias("links"))
    whole = seen.where("whole").select(F.col("cid"), F.col("root").alias("label"))
    if seen.where("not whole").limit(1).count():
        parts = components(seen.where("not whole").select(F.col("cid").alias("u"), F.col("root").alias("v")))
        whole = whole.unionByName(parts.select(F.col("node").alias("cid"), F.col("component").alias("label")))
    labelled = classes.where("n > 0").select("key", "n_docs", "n", "cid", "first_doc").join(whole, "cid", "left").join(links, "cid", "left")
    labelled = persisted(labelled.withColumns({"label": F.coalesce("label", "cid"), "links": F.coalesce("links", F.lit(0).cast("long"))}), "labelled")
    least = labelled.groupBy("label").agg(F.min("first_doc").alias("least"))
    out = persisted(labelled.join(least, "label").select("key", "n_docs", "n", "cid", "label", "links", "least", "first_doc"), "classified")
    swept(mark, out)
    return out


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) a document: the least number of its group, and how many other documents it is linked to."""
    classes = classify(docs).select("key", F.col("least").alias("_least"), (F.col("links") + F.col("n_docs") - 1).alias("_links"))
    keyed = docs.select("doc_id", _key().alias("key"))
    # The join deals out keys and numbers only; copies of one text make it skewed, which splits at run time.
    out = keyed.join(classes, "key", "left")
    return out.select("doc_id", F.coalesce("_least", "doc_id").alias("class_id"), F.coalesce("_links", F.lit(0).cast("long")).alias("n_links"))


def dedupe(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, that of the least number; texts without words all stay."""
    without(docs, *["_nd_" + x for x in ("key", "stay", "many", "row")])
    mark = made()
    classes = classify(docs)
    # The class that stays holds the group's least number; on ties, or without numbers, the least class.
    order = F.struct(F.coalesce("first_doc", F.lit(2**63 - 1)), "cid")
    stays = classes.groupBy("label").agg(F.min(order)["cid"].alias("stay"))
    judged = classes.join(stays, "label").select(F.col("key").alias("_nd_key"), (F.col("cid") == F.col("stay")).alias("_nd_stay"), (F.col("n_docs") > 1).alias("_nd_many"))
    # Only texts that go or have copies matter; all others pass without a shuffle.
    judged = persisted(judged.where("_nd_many or not _nd_stay"), "judged")
    swept(mark, judged)
    table = F.broadcast(judged) if judged.count() <= BROADCAST else judged
    marked = docs.withColumn("_nd_key", _key()).join(table, "_nd_key", "left")
    alone = marked.where("_nd_stay is null").select(*docs.columns)
    row = F.struct(*docs.columns)
    one = marked.where("_nd_stay").groupBy("_nd_key").agg(F.min_by(row, F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), F.xxhash64(*docs.columns))).alias("_nd_row"))
    return alone.unionByName(one.select("_nd_row.*").select(*docs.columns))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class and its number of links."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
