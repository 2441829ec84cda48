"""Valid packings near the lower bound, exact pieces, edge cases."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.llm import packing
from keyloom.llm._shared import tokenizer_path


def fewest(lengths, capacity):
    """The least number of bins, by trying all placements."""
    best = [len(lengths)]

    def place(i, free):
        if len(free) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(free)
            return
        for k in range(len(free)):
            if free[k] >= lengths[i]:
                place(i + 1, [*free[:k], free[k] - lengths[i], *free[k + 1 :]])
        place(i + 1, [*free, capacity - lengths[i]])

    place(0, [])
    return best[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_small_cases_are_near_the_best(lengths):
    bins = packing.Bins(np.array(lengths), 20)
    bins.best_fit()
    before = sum((20 - f) ** 2 for f in bins.free)
    bins.search()
    assert sum((20 - f) ** 2 for f in bins.free) >= before
    used = [b for b in bins.bins if b]
    assert sorted(i for b in used for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 20 for b in used)
    assert len(used) <= fewest(lengths, 20) + 1


def test_search_empties_bins_that_best_fit_leaves():
    bins = packing.Bins(np.array([12, 5, 12, 5, 8, 5, 8, 5]), 20)
    bins.bins, bins.free = [[0, 1], [2, 3], [4, 5], [6, 7]], [3, 3, 7, 7]
    bins.search()
    assert sum(map(bool, bins.bins)) == 3


def test_large_random_lengths_reach_the_bound():
    lengths = np.random.RandomState(1).randint(1, 2049, 20_000)
    bins = packing.Bins(lengths)
    bins.best_fit()
    bins.search()
    assert sum(map(bool, bins.bins)) <= 1.01 * math.ceil(lengths.sum() / 2048)


def test_search_saves_the_same_share_in_large_groups():
    shares = []
    for n in (1500, 8000):
        lengths = np.random.RandomState(3).randint(600, 901, n)
        bins = packing.Bins(lengths)
        bins.best_fit()
        before = len(bins.bins)
        bins.search()
        used = [b for b in bins.bins if b]
        assert sorted(i for b in used for i in b) == list(range(n))
        assert all(lengths[b].sum() == 2048 - f for b, f in zip(bins.bins, bins.free, strict=True) if b)
        shares.append(1 - len(used) / before)
    assert shares[1] > 0.85 * shares[0] > 0.02


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)]


def test_documents(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = [(i, "some words here " * (i * 37 % 90), "x") for i in range(120)] + [(None, None, None), (5, "", "y"), (5, "", "y"), (6, "long text of words " * 3000, "z"), (7, "one <|endoftext|> two", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.packed(docs).collect()
    want = []
    for number, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(number, i, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for i, (a, n) in enumerate(packing.cut(len(ids)))]
    key = lambda x: (x[0] is not None, x)
    assert sorted((tuple(r)[:5] for r in got), key=lambda x: str(x)) == sorted(want, key=lambda x: str(x))
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= 1 + math.ceil(sum(r.length for r in got) / 2048)
    assert packing.packed(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 2)], "length long, offset long"))
    some = packing.pack(spark.range(1000).select(F.lit(7).cast("long").alias("length"), "id"), capacity=20, group=100)
    assert some.select("id").distinct().count() == 1000
