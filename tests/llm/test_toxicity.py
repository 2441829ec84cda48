"""The automaton against plain edit distance, learning on planted terms, edge cases."""

import math
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.llm import toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


TERMS = [("abcab", False), ("bcabcabca", False), ("aab", False), ("cca", True), ("abcbb", False)]
AUTOMATON = toxicity.Automaton(TERMS)


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet="abcd", max_size=12))
def test_automaton_equals_edit_distance(word):
    near = [(distance(word, t), n) for n, (t, stem) in enumerate(TERMS) if not stem and distance(word, t) <= toxicity.edits_allowed(t, False)]
    if word.startswith("cca"):
        near.append((0, 3))
    got = AUTOMATON.match(word)
    assert (got is None) == (not near)
    if near:
        assert got[1] == min(near)[0] and (got[1], got[0]) in near


def planted(spark, n=600, bad=("grumpfwit", "zonkhead", "blargface")):
    import random

    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("bdeilmnorstu") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words, toxic = [rng.choice(vocabulary) for _ in range(60)], i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), labels


def test_held_out_accuracy_and_misspelling(spark):
    docs, labels, truth = planted(spark)
    model = toxicity.fit(docs, labels)
    assert {t for t, _ in model.terms} == {"grumpfwit", "zonkhead", "blargface"} or all(t[0] in ("g", "z", "b") for t, _ in model.terms)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).select("doc_id", "score").collect()}
    held = [(i, t) for i, t in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all((got[i] >= 0.7) == bool(t) for i, t in held)
    score = model.scorer()
    assert score("you zonkheed of rain") > 0.5 > score("you of rain")
    assert score('he wrote "zonkhead" here') < score("he wrote zonkhead here")
    assert score("they called him a zonkhead") < score("go away zonkhead")


def test_quotation_is_told_from_abuse(spark):
    docs, labels, _ = planted(spark)
    score = toxicity.fit(docs, labels).scorer()
    bare = score("go away zonkhead you fool")
    assert bare >= toxicity.THRESHOLD
    quoted = ['the line "go away zonkhead you fool" appears in the play', "it reads «vas y zonkhead va» here", "er las „geh weg zonkhead“ vor", "it's the line ‘you zonkhead!’ again", "the line 'don't go zonkhead' of it", '"zonkhead" appears']
    assert max(score(t) for t in quoted) < toxicity.THRESHOLD, [(t, score(t)) for t in quoted]
    abuse = ['"go away" zonkhead you "fool"', 'a 5" zonkhead 6" wide', 'he is "great, a zonkhead', 'don\'t you zonkhead, it\'s late', '"x\nzonkhead\ny"', 'zonkhead "', '" zonkhead "']
    assert all(score(t) == bare for t in abuse)


def test_long_texts_with_many_weak_hits_take_linear_time():
    model = toxicity.Model(prior=-2.0, terms=(("zonkhead", False),), weights=(1e-4,), fuzzy=(1e-4, 1e-4))
    for text in ("zonkhead " * 20_000, '"zonkhead ' * 20_000, "x" * 400_000 + " zonkhaed" * 9_000):
        assert 0 < model.scorer()(text) < 1


def test_short_and_long_terms_are_learnt(spark):
    long = "grumpf" * 5
    docs, labels, truth = planted(spark, 900, bad=("zok", "qi", long))
    model = toxicity.fit(docs, labels)
    names = {t for t, stem in model.terms}
    assert {"zok", "qi"} <= names and any(long.startswith(t) for t in names)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).select("doc_id", "score").collect()}
    assert all((got[i] >= toxicity.THRESHOLD) == bool(t) for i, t in truth if zlib.crc32(str(i).encode()) % 3 == 1)


def plain_score(model, text):
    """The score by trying every term on every word."""
    total, low = model.prior, (text or "").lower()
    for m in toxicity._WORD.finditer(low):
        hits = []
        for n, (term, stem) in enumerate(model.terms):
            if stem and m[0].startswith(term):
                hits.append((0, not stem, n))
            elif not stem and distance(m[0], term) <= toxicity.edits_allowed(term, False):
                hits.append((distance(m[0], term), not stem, n))
        if hits:
            edits, _, n = min(hits)
            if edits == 0:
                w = model.weights[n]
            elif m[0] in model.benign:
                w = 0.0
            else:  # terms equally near differ in weight only above the weight of a misspelling
                w = min(model.weights[n], model.fuzzy[edits - 1])
            total += w * toxicity._stance(low, m.start(), m.end())
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def test_the_whole_query_equals_a_plain_scorer(spark, tmp_path):
    import random

    rng = random.Random(9)
    docs, labels, _ = planted(spark)
    model = toxicity.fit(docs, labels)
    words = ["grumpfwit", "zonkhead", "blargface", "zonkhaed", "grumpfwxt", "blrgface", "said", "rain", '"', "zonkheadx", "Zonkhead", "quote"]
    extra = [(10_000 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(9)))) for i in range(150)] + [(20_000, None), (20_001, ""), (None, "zonkhead")]
    every = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    every.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    texts = {r.doc_id: r.text for r in every.collect()}
    got = toxicity.op10_toxicity(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i in texts)
    for r in got:
        want = plain_score(model, texts[r.doc_id])
        assert math.isclose(r.score, want, rel_tol=1e-9), (texts[r.doc_id], r.score, want)
        assert r.predicted == int(r.score >= 0.7) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_a_lower_cap_leaves_prior_and_decisions(spark):
    docs, labels, truth = planted(spark, 1500)
    labels = labels.where("doc_id % 10 != 5")  # half of the toxic ones
    whole, capped = toxicity.fit(docs, labels), toxicity.fit(docs, labels, most=250)
    learnt = [t for i, t in truth if i % 10 != 5 and zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(learnt) - sum(learnt) > 500 and math.isclose(whole.prior, math.log((sum(learnt) + 1) / (len(learnt) - sum(learnt) + 1)))
    texts = ["go away zonkhead", 'he wrote "zonkhead" here', "you zonkheed of rain", "you grumpfwxtt of rain", "they called him a zonkheed", "you of rain"]
    a, b = whole.scorer(), capped.scorer()
    assert [a(t) >= toxicity.THRESHOLD for t in texts] == [b(t) >= toxicity.THRESHOLD for t in texts] == [True, *[False] * 5]
    assert whole.prior == capped.prior


def test_edge_cases(spark):
    docs, labels, _ = planted(spark, 200)
    odd = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, "", "b"), (2, "x" * 500_000, None)], "doc_id long, text string, label string")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(odd, model).collect()
    assert len({round(r.score, 12) for r in rows}) == 1 and rows[0].label == "a"
    empty = toxicity.fit(docs.limit(0), labels)
    assert empty.terms == () and toxicity.score(odd, empty).count() == 4
    nulls = labels.withColumn("toxic", F.lit(None).cast("int"))
    assert toxicity.fit(docs, nulls).terms == ()
    with pytest.raises(ValueError):
        toxicity.score(docs.withColumn("score", F.lit(1)), model)
