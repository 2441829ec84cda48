"""Statistics and estimates against plain Python, outliers, edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import quality


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [s for s in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_plain_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab c\n\t*é|\x0b ") for _ in range(rng.randint(0, 400))) for _ in range(150)]
    texts += ["a b c d e f g h " * 3, "x " * 40, None, "", " \n\n ", "q w e r t y u i", "same\nsame\n \nsame", "w" * 100_000, "a b c d e f g h i " * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[2:] for r in quality.statistics(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain(t), t and t[:50]


def estimate(x):
    """The same estimate of one group in numpy: features as whole thousandths."""
    floors = np.diag(np.square(quality.FLOORS))
    q = []
    for f in x.T:
        b, n = Counter((int(v) // 20 for v in f)), len(f)
        for k in (1, 2, 3):
            run = 0
            for key in sorted(b):
                run += b[key]
                if run * 4 >= n * k:
                    q.append((key * 20 + 10) / 1000)
                    break
    q = np.array(q).reshape(-1, 3)
    y = x / 1000
    ends = []
    for mean, cov in ((q[:, 1], np.diag(((q[:, 2] - q[:, 0]) / 1.349) ** 2)), (y.mean(0), np.cov(y.T, bias=True))):
        last = None
        while True:
            bins = binned(squared(y, mean, cov + floors))
            upto = next(b for b in sorted(set(bins)) if (bins <= b).sum() * 4 >= len(y) * 3)
            mean, cov = y[bins <= upto].mean(0), np.cov(y[bins <= upto].T, bias=True)
            size = math.log(np.linalg.det(cov + floors)) / 2
            if last is not None and size >= last[0] - quality.LESS:
                break
            last = (size, mean, cov + floors)
        ends.append(last)
    return min(ends, key=lambda e: round(e[0], 6))


def squared(y, mean, cov):
    d = y - mean
    return np.einsum("ij,ij->i", d, np.linalg.solve(cov, d.T).T)


def binned(d2):
    return np.floor(np.log2(1 + d2) * 16)


def distances(x):
    """Squared distances of the rows of one group, scaled so that the median is that of the chi-square."""
    _, mean, cov = estimate(x)
    d2 = squared(x / 1000, mean, cov)
    bins = binned(d2)
    median = next(b for b in sorted(set(bins)) if (bins <= b).sum() * 2 >= len(x))
    return d2 * min(1.0, quality.MEDIAN / (2 ** ((median + 1) / 16) - 1))


def test_estimates_equal_numpy(spark):
    rng = np.random.RandomState(0)
    groups = {k: np.round(np.vstack([rng.multivariate_normal([5, 1.5, 0.1, 0.2, 0.1], np.diag([1, 0.02, 0.1, 0.1, 0.01]), n), rng.normal(9, 0.3, (n // 6, 5))]) * 1000).astype(int) for k, n in (("a", 300), ("b", 90))}
    rows = [(k, i, *map(int, v)) for k, x in groups.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "_q_key string, doc_id long, " + ", ".join(f"{f} long" for f in quality.FEATURES))
    for r in quality.estimates(df).collect():
        _, mean, cov = estimate(groups[r._q_key].astype(float))
        low = np.array([[r[f"l_{i}_{j}"] if j <= i else 0 for j in range(5)] for i in range(5)])
        assert np.allclose([r[f"m_{i}"] for i in range(5)], mean) and np.allclose(low @ low.T, cov)
        assert mean[0] < 6  # the sixth that lies far off has no say


def test_verdicts_equal_numpy(spark, monkeypatch):
    """Distances and verdicts of whole texts against the same rules in numpy, with broadcast and with salted joins."""
    rng = random.Random(8)
    word = lambda n=9: "".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, n)))
    rows = []
    for i in range(420):
        words = [word(9 if i % 5 else 4) + ("*#" if rng.random() < 0.002 * (i % 50) else "") for _ in range(rng.randint(10, 200))]
        rows.append((i, " ".join(words) + ("\n" + " ".join(words[:12])) * (i % 9 == 0) * 2, ("en", "de")[i % 7 == 0], ("s1", "s2", "s3")[i % 3 if i % 7 else 0] if i > 30 else None))
    stats = [plain(t) for _, t, _, _ in rows]
    failed = [n < 20 or 100 * r > 30 * n for n, _, _, _, r in stats]
    spare = [(n, c, s, d, r) if not f else None for (n, c, s, d, r), f in zip(stats, failed, strict=True)]
    half = lambda v: math.floor(v * 1000 + 0.5)
    x = {i: [half(v) for v in (math.log(p[0]), math.log(p[1] / p[0]), math.log(1 + 100 * p[2] / p[1]), math.log(1 + p[3]), math.sqrt(p[4] / p[0]))] for i, p in enumerate(spare) if p}
    groups = {}
    for i in x:
        groups.setdefault(rows[i][2:], []).append(i)
    pooled = {}
    for (lang, source), own in groups.items():
        small = [k for k in groups if k[0] == lang and len(groups[k]) < quality.LEAST]
        level = (lang, source) if len(own) >= quality.LEAST else (lang,) if sum(len(groups[k]) for k in small) >= quality.LEAST else ()
        pooled.setdefault(level, []).extend(own)
    want = {}
    for own in pooled.values():
        d = distances(np.array([x[i] for i in own], float)) if len(own) >= quality.LEAST else [None] * len(own)
        want.update(zip(own, d, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for broadcast in (quality.BROADCAST, -1):
        monkeypatch.setattr(quality, "BROADCAST", broadcast)
        got = quality.verdicts(df).collect()
        assert len(got) == len(rows) and {r.base_failed for r in got} == {True, False}
        for r in got:
            d = want.get(r.doc_id)
            assert r.base_failed == failed[r.doc_id] and (d is None) == (r.distance is None)
            assert d is None or math.isclose(d, r.distance, rel_tol=1e-6, abs_tol=1e-9)
            assert r.kept == (not failed[r.doc_id] and (d is None or d <= quality.CUT))


def test_verdicts_and_edge_cases(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 9)))
    good = [(i, " ".join(word() for _ in range(rng.randint(60, 400))), "en" if i % 3 else None, "s1" if i % 2 else "s2", "v") for i in range(300)]
    bad = [(1000 + i, " ".join(word() + "***" for _ in range(rng.randint(60, 400))), "en", "s1", "v") for i in range(8)]
    odd = [(None, None, None, None, None), (7, "", "en", "s1", "v"), (1000, bad[0][1], "en", "s1", "v"), (8, "one two three " * 40, "xx", "s9", "v"), (9, " ".join(word() for _ in range(80)), "xx", "s9", "v")]
    df = spark.createDataFrame(good + bad + odd, "doc_id long, text string, lang string, source string, n_chars string")
    got = quality.verdicts(df).collect()
    assert len(got) == len(good + bad + odd)
    kept = {(r.doc_id, r.kept) for r in got}
    assert all((i, True) in kept for i, *_ in good) and all((b[0], False) in kept for b in bad)
    assert {(None, False), (7, False), (8, False), (9, True)} <= kept
    assert quality.verdicts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        quality.verdicts(df.withColumn("kept", F.lit(1)))
