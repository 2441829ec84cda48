"""Links and groups against all pairs, with and without chunks; pruning; components; edge cases."""

import random

import numpy as np
import pytest

from keyloom.llm import near_duplicates as nd


def plain_shingles(text):
    words = (text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(doc_id, class_id, n_links) from all pairs."""
    sets = [plain_shingles(t) for _, t in rows]
    links = {i: [j for j in range(len(rows)) if i != j and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(rows))}
    label = {}
    for i in range(len(rows)):
        if i not in label:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = i
                    todo += links[x]
    groups = {}
    for i, g in label.items():
        groups.setdefault(g, []).append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((rows[i][0], least[label[i]], len(links[i])) for i in range(len(rows))), key=str)


def corpus(n=120, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    shared = [word() for _ in range(40)]
    texts = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(30, 120))] + shared * (i % 3 == 0)
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3])):  # copies with up to a few words changed
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(rng.choice(["\n", " ", "  "]).join(copy))
    base = [word() for _ in range(60)]
    for i in range(40):  # one large group, a chain of small changes
        base[i] = word()
        texts.append(" ".join(base))
    texts += ["", " \n", None, "one two", "one two", "one  two", "a b c d e", "a b c d e f"]
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, rows[8][1]), (None, "alone here with no number at all")]


@pytest.mark.parametrize("bucket,shingles", [((256, 64, 16_384), 10**6), ((2, 64, 4), 900)])
def test_join_equals_all_pairs(spark, monkeypatch, bucket, shingles):
    monkeypatch.setattr(nd, "BUCKET_CHUNK", bucket)
    monkeypatch.setattr(nd, "SHINGLE_CHUNK", shingles)
    monkeypatch.setattr(nd, "BROADCAST", 10**6 if bucket[0] > 10 else 0)
    rows = corpus()
    got = nd.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


@pytest.mark.parametrize("bucket", [(256, 64, 16_384), (3, 64, 8)])
def test_a_bucket_meets_all_that_its_first_leaves_apart(spark, monkeypatch, bucket):
    """Members of one bucket in families that differ: edges connect each family, and nothing else."""
    monkeypatch.setattr(nd, "BUCKET_CHUNK", bucket)
    rng = np.random.RandomState(6)
    values = nd.BANDS * nd.ROWS
    families = rng.randint(0, 256, (9, values))
    rows = []
    for cid in range(120):
        own = np.where(rng.rand(values) < 0.95, families[cid % 9], rng.randint(0, 256, values)).astype(np.uint8)
        rows.append((cid, 10, bytearray(own.tobytes()), [7] + [1000 * cid + k for k in range(1, 4)]))
    classes = spark.createDataFrame(rows, "cid long, n long, sig binary, bands array<long>")
    label = {i: i for i in range(120)}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    edges = nd.candidates(classes).collect()
    for e in edges:
        label[top(e.u)] = top(e.v)
    assert all((top(a) == top(b)) == (a % 9 == b % 9) for a in range(120) for b in range(120))


def test_recall_on_the_test_documents(spark):
    """All links between texts of the test table, by an inverted index; every one must be found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    sets, holders = [plain_shingles(t) for _, t in rows], {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    label, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in holders[x]:
                common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if j != i and 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                label[top(i)] = top(j)
    least = {}
    for i, (number, _) in enumerate(rows):
        least[top(i)] = min(number, least.get(top(i), number))
    want = sorted((number, least[top(i)], links[i]) for i, (number, _) in enumerate(rows))
    got = sorted(map(tuple, nd.join(docs).collect()))
    print("links found", sum(r[2] for r in got), "of", sum(r[2] for r in want))
    assert sum(r[2] for r in want) > 100 and got == want


def test_words_with_one_checksum_differ():
    a, b = "plumless", "buckeroo"  # equal in 32 bits and in length
    import zlib

    assert zlib.crc32(a.encode()) == zlib.crc32(b.encode())
    assert nd.shingles(a).tolist() != nd.shingles(b).tolist()


def test_dedupe_keeps_one_of_each_group(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sig string, n int")
    out = nd.dedupe(docs)
    assert out.schema == docs.schema
    kept = out.collect()
    want = brute(rows)
    wordless = [i for i, t in rows if not plain_shingles(t)]
    groups = {c for i, c, _ in want if i not in wordless} - {None}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted([*groups, *wordless])
    assert sum(r.doc_id is None for r in kept) == 1  # the text alone without a number
    assert nd.dedupe(docs.limit(0)).count() == 0 and nd.join(docs.limit(0)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.RandomState(0)
    a = rng.randint(0, 256, (20_000, nd.BANDS * nd.ROWS)).astype(np.uint8)
    for similarity, share in ((0.8, 0.999), (0.9, 1.0)):
        b = np.where(rng.rand(*a.shape) < similarity, a, rng.randint(0, 256, a.shape)).astype(np.uint8)
        assert nd.plausible(a, b).mean() >= share
    b = np.where(rng.rand(*a.shape) < 0.3, a, rng.randint(0, 256, a.shape)).astype(np.uint8)
    assert nd.plausible(a, b).mean() < 0.001


def test_incidence_equals_sets():
    rng = np.random.RandomState(1)
    sets = [np.unique(rng.choice(400, rng.randint(1, 90)) * (1 + (i % 2) * 1000)).astype(np.uint64) for i in range(150)] + [np.arange(5, dtype=np.uint64)] * 3
    inc = nd.Incidence(sets)
    for i in range(0, len(sets), 11):
        assert inc.common(i).tolist() == [len(np.intersect1d(sets[i], s)) for s in sets]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)]
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    got = {r.node: r.component for r in nd.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: c for x, c in label.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_bands_lose_no_more_than_the_tolerance():
    assert (1 - (nd.THRESHOLD[0] / nd.THRESHOLD[1]) ** nd.ROWS) ** nd.BANDS <= nd.TOLERANCE
    rng = np.random.RandomState(11)
    a = rng.randint(0, 2**32, (20_000, nd.BANDS * nd.ROWS), np.uint64).astype(np.uint32)
    b = np.where(rng.rand(*a.shape) < 0.8, a, a + np.uint32(1))
    assert all((nd._bands(x) == nd._bands(y)).any() for x, y in zip(a, b, strict=True))
