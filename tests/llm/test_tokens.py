"""Exact encodings, round trips through both file formats, edge cases."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.llm import _files, token_counts, token_output
from keyloom.llm._shared import WordEncoder, tokenizer_path


def library(literal):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = literal
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def plain():
    return library(False)


@pytest.fixture(scope="module")
def spelt():
    return library(True)


ENCODERS = [WordEncoder(tokenizer_path(), most=30, literal=x) for x in (False, True)]
SPECIAL = st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "a", "b.", "\u00a0", "<|", "'s"]), max_size=12).map("".join)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(alphabet="ab 's\n\t.é1  \x1c<|endoftext|>", max_size=30) | SPECIAL, max_size=4))
def test_pieces_encode_like_whole_texts(plain, spelt, texts):
    for encoder, want in ((ENCODERS[0], plain), (ENCODERS[1], spelt)):
        got = encoder.encode(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [want(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=700) | st.lists(st.integers(0, 50), max_size=2000))
def test_elias_fano(values):
    values = sorted(values)
    data = token_output.Sequence.of(np.array(values, np.uint64)).to_bytes()
    seq, end = token_output.Sequence.from_bytes(memoryview(data), 0)
    assert end == len(data) and seq.selected(0, len(values)).tolist() == values
    assert [seq.select(i) for i in range(0, len(values), 7)] == values[::7]
    for a in range(0, len(values), 97):
        for n in (0, 1, 255, 256, 300):
            assert seq.selected(a, min(n, len(values) - a)).tolist() == values[a : a + n]
    with pytest.raises(IndexError):
        seq.selected(0, len(values) + 1)


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.RandomState(0).randint(1, 1000, 100_000))
    assert len(token_output.Sequence.of(ends).to_bytes()) * 8 / 100_000 < 12


ROWS = [(3, "a b  c", 1), (None, None, 2), (1, "", 3), (3, "x y z " * 300, 4), (1, "", 5), (-7, "Ünï <|endoftext|> !", 6)]


def docs_of(spark):
    more = [(100 + i, "word " * (i % 5) + "end", i) for i in range(50)]
    return spark.createDataFrame(ROWS + more, "doc_id long, text string, ids long")


def test_output_round_trip(spark, tmp_path, plain):
    docs = docs_of(spark)
    shards = token_output.write(docs, f"file://{tmp_path}/klef", tokenizer_path(), shard_ids=100)
    got = token_output.read(shards).orderBy("start").collect()
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [r.doc_id for r in order]
    start = 0
    for r in got:
        assert r.start == start
        start += len(r.ids) // 4
    want = sorted((r.doc_id is not None, r.doc_id or 0, zlib.crc32(np.array([*plain(r.text or ""), 2], "<u4").tobytes())) for r in order)
    assert sorted((r.doc_id is not None, r.doc_id or 0, zlib.crc32(r.ids)) for r in got) == want
    again = token_output.read(token_output.shards_below(spark, f"file://{tmp_path}/klef")).orderBy("start").collect()
    assert again == got
    assert any(50256 in np.frombuffer(r.ids, "<u4") for r in got)
    shard = token_output.Shard(_files.read_all(shards.orderBy("part", "seq").first().path))
    assert shard.numbers(0, shard.n_docs)[:2] == [None, -7] and shard.numbers(1, 1) == [-7]
    assert shard.document(0).tolist() == np.frombuffer(got[0].ids, "<u4").tolist()
    assert token_output.read(token_output.write(docs.limit(0), f"file://{tmp_path}/none", tokenizer_path())).count() == 0


@pytest.mark.parametrize("block", [1, 7, 64, 10**6])
def test_counts_across_blocks(spark, tmp_path, block):
    rng = random.Random(block)
    folder = tmp_path / "flat"
    folder.mkdir()
    want = []
    for k in range(3):
        ids = [rng.choice([9, 9, 9, 8, 7]) for _ in range(rng.randint(0, 300))]
        (folder / f"part-{k}.ids").write_bytes(np.array(ids, "<u2").tobytes())
        start, place = 0, 0
        for i, x in enumerate([*ids, None]):
            if x == 8 or (x is None and start < i):
                want.append((f"part-{k}.ids", place, start, i - start, x == 8))
                start, place = i + 1, place + 1
    got = token_counts.count(spark, f"file://{folder}", end_id=8, block_ids=block).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_counts_of_documents(spark, tmp_path, spelt):
    docs = docs_of(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = token_counts.op4_token_counts(spark, str(tmp_path)).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted([(r.doc_id, r.n_tokens) for r in got], key=key) == sorted([(r.doc_id, len(spelt(r.text or ""))) for r in docs.collect()], key=key)
