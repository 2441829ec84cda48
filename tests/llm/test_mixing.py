"""Targets against repeated resharing, totals near targets, SQL, edge cases."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.llm import mixing


def reshared(sizes):
    """Targets by resharing the excess until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        open_ = sum(w for s, w in weight.items() if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else weight[s] * left / open_ for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


@settings(max_examples=25, deadline=None)
@given(sizes=st.dictionaries(st.sampled_from(["a", "b", "é", "Z", "\U0001f600", None, "zz", ""]), st.integers(0, 1000), min_size=1))
def test_targets_equal_resharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = reshared(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def table(spark, n=3000):
    rows = [(i, " ".join(["w"] * (i * 7919 % 97)), "big" if i % 3 else f"s{i % 7}", "x") for i in range(n)]
    rows += [(None, None, None, None), (5, "", "s1", "y"), (5, "", "s1", "y"), (6, "a b", None, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_taken_is_near_targets_and_equals_sql(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op6_mixing(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(mixing.OP6_SQL).fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 97 * 3


def test_mix_repeats_documents_and_keeps_columns(spark):
    docs = table(spark, 200)
    docs = docs.unionByName(docs.sparkSession.createDataFrame([(900, "long words " * 150_000, "s1", "x")], docs.schema))
    assert mixing.plan(docs.select("doc_id", "source", F.size(mixing.words(F.col("text"))).cast("long").alias("_mix_size"))).where("doc_id = 900").first()._mix_size == 300_000
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert out.count() == mixing.mix(docs).count()
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumn("_mix_at", F.lit(1)))
