"""The pipeline stage by stage, and as one query."""

from collections import Counter

import pytest

import corpus_pipeline as cp
from keyloom.llm import _shared, near_duplicates, pii, queries, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES:
        before, out = docs, stage(spark, docs, SF)
        rows = out.collect()
        if name != "packing":
            assert out.columns == columns
            docs = spark.createDataFrame(rows, out.schema)
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in toxicity.score(before, model).where("score < 0.7").collect())
        if name == "near duplicates":
            groups = {r.class_id for r in near_duplicates.join(before).collect()}
            assert sorted(r.doc_id for r in rows) == sorted(groups) and len(rows) < before.count()
        if name == "personal data":
            assert {(r.doc_id, pii.redacted(r.text)) for r in before.collect()} == {(r.doc_id, r.text) for r in rows}
        if name == "mixing":
            assert max(Counter(r.doc_id for r in rows).values()) <= 3 and {r.doc_id for r in rows} <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "packing":
            pieces = Counter(r.doc_id for r in rows if r.piece == 0)
            assert pieces == Counter(r.doc_id for r in before.select("doc_id").collect())


def test_edge_cases(spark, tmp_path):
    words = lambda i: " ".join(f"w{i}x{k * 7919 % 101}" for k in range(30))
    rows = [(i, words(i), "en", "s1" if i % 3 else None, 5, "c") for i in range(40)]
    odd = [(100, None, "en", "s1", None, None), (101, "", None, "s2", 0, "c"), (None, words(200), None, None, None, None), (102, " \n", "en", None, 1, "c"), (7, words(7), "en", "s1", 5, "c"), (7, words(7), "en", "s1", 5, "c"), (103, "mail me@host.example.org " + words(103) * 2000, "en", "s1", 1, "c")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, quality string"
    spark.createDataFrame(rows + odd, schema).write.parquet(str(tmp_path / "a/documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, None, None), (2, 0, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "a/labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "a/documents.parquet"))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path / "a")).collect()
        docs = spark.createDataFrame(out, schema)
        assert len(out) == (len(rows + odd) if name == "toxicity" else len(out))
        if name == "near duplicates":
            assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out) == sorted({(i is not None, i or 0) for i, *_ in rows + odd})
        if name == "personal data":
            long = next(r.text for r in out if r.doc_id == 103)
            assert "<EMAIL>" in long and "@" not in long and {r.text for r in out if r.doc_id == 100} == {None}
    out = cp.run(spark, str(tmp_path / "a")).collect()
    assert {r.doc_id for r in out} <= {i for i, *_ in rows + odd} and all(r.length > 0 for r in out)
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "b/documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "b/labels.parquet"))
    assert cp.run(spark, str(tmp_path / "b")).count() == 0
    clash = docs.withColumn("score", docs.doc_id)
    with pytest.raises(ValueError):
        cp.STAGES[0][1](spark, clash, str(tmp_path / "a"))


def test_intermediate_tables_go(spark):
    before = set(_shared._tables)
    out = cp.run(spark, SF)
    assert out.count() > 0
    made = [p.rpartition("-")[2] for p in set(_shared._tables) - before]
    assert sorted(made) == ["mixing", "pieces"]  # what the result reads


def test_run_and_registration(spark):
    assert len(queries.QUERIES) == 10 and {q.split("_")[0] for q in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
