"""The six-row fixture, relations between operators, models, layouts, sources, streams."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions import hashing, models
from keyloom.operators import joins, lookup, ordering, reports, sets, sorting, stats, tables
from keyloom.sources import binary_keys, generators, relations
from keyloom.streaming import probe

ROWS = [(0, 3), (1, 7), (5, 13), (8, 42), (9, 69), (10, 1337)]


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(ROWS, "key long, payload long")


def keys(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "probe_id long, key long")


def test_fixture_lookups(spark, golden):
    got = {r.key: r.payload for r in lookup.payload(golden, keys(spark, range(12))).collect()}
    assert got == {k: dict(ROWS).get(k) for k in range(12)}
    found = {r.key: r.found for r in lookup.point(golden, keys(spark, [2, 3, 4, 6, 7, 8])).collect()}
    assert found == {2: 0, 3: 0, 4: 0, 6: 0, 7: 0, 8: 1}
    assert {r.key: r.rank for r in models.rank_model(golden).collect()}[8] == 3


def test_fixture_scans_and_ranges(spark, golden):
    folded = {r.key: r.folded for r in lookup.next_xor(golden, keys(spark, [5, 4, 10, 11]), 3).collect()}
    assert folded == {5: 13 ^ 42 ^ 69, 4: 13 ^ 42 ^ 69, 10: 1337, 11: 0}
    q = spark.createDataFrame([(1, 1, 9), (2, 2, 4), (3, 9, 1), (4, -5, 99), (5, None, 9), (6, 1, None), (7, None, None), (8, -5000, 5000), (None, 8, 8)], "query_id long, lo long, hi long")
    for df in (lookup.ranges(golden, q), lookup.ranges_by_band(golden, q, 4)):
        assert {r.query_id: (r.n, r.total) for r in df.collect()} == {1: (4, 131), 2: (0, 0), 3: (0, 0), 4: (6, 1471), 5: (0, 0), 6: (0, 0), 7: (0, 0), 8: (6, 1471), None: (1, 42)}
    twice = spark.createDataFrame([(1, 0, 5), (1, 0, 5), (1, 8, 10)], "query_id long, lo long, hi long")
    for df in (lookup.ranges(golden, twice), lookup.ranges_by_band(golden, twice, 4)):
        assert sorted((r.n, r.total) for r in df.collect()) == [(3, 23), (3, 23), (3, 1448)]
    nulls = spark.createDataFrame([(None, 1), (0, 3), (1, 7), (None, 9)], "key long, payload long")
    got = {r.probe_id: r.folded for r in lookup.next_xor(nulls, keys(spark, [None, 0, 1, 2]), 2).collect()}
    assert got == {0: 0, 1: 3 ^ 7, 2: 7, 3: 0}
    assert [r.n for r in lookup.ranges(nulls, twice).collect()] == [2, 2, 0]


def test_fixture_iteration(spark, golden):
    for start, _ in ROWS:
        assert [r.payload for r in lookup.walk(golden, start).collect()] == [v for k, v in ROWS if k >= start]
    got = {}
    for r in lookup.iterate(golden, keys(spark, [0, 2, 9, 11, None]), 3).orderBy("probe_id", "step").collect():
        got.setdefault(r.probe_id, []).append(r.payload)
    assert got == {0: [3, 7, 13], 1: [13, 42, 69], 2: [69, 1337]}


@pytest.mark.parametrize("n", [1, 2, 7, 50])
def test_scans_equal_plain_loops(spark, n):
    rng = random.Random(n)
    rows = [(rng.randrange(60), rng.randrange(1000)) for _ in range(150)]
    rel = spark.createDataFrame(rows, "key long, payload long")
    asked = list(range(-2, 64))
    got = {r.key: r.folded for r in lookup.next_xor(rel, keys(spark, asked), n).collect()}
    ordered = sorted(rows)
    for k in asked:
        want = 0
        for _, v in [x for x in ordered if x[0] >= k][:n]:
            want ^= v
        assert got[k] == want


def test_joins_agree(spark):
    rng = random.Random(0)
    build = spark.createDataFrame([(rng.randrange(50), i) for i in range(80)] + [(None, 0)], "key long, payload long")
    s = spark.createDataFrame([(rng.randrange(80),) for _ in range(200)] + [(None,)], "key long")
    count = lambda x: joins.matches(build, s, x).first().matches
    semi = {x: count(x) for x, (how, _) in joins.STRATEGIES.items() if how == "left_semi"}
    inner = {x: count(x) for x, (how, _) in joins.STRATEGIES.items() if how == "inner"}
    assert len(set(semi.values())) == len(set(inner.values())) == 1, (semi, inner)
    semi, inner = set(semi.values()), set(inner.values())
    assert semi.pop() + count("miss") == 201
    rows = lambda x: sorted(map(tuple, joins.join(build, s.withColumn("tag", F.lit("t")), x).select("key", "tag", *(["payload"] if joins.STRATEGIES[x][0] == "inner" else [])).collect()))
    assert rows("learned_index") == rows("css_tree") == rows("learned_sort_merge") == rows("auto") == rows("hash")
    assert rows("gapped") == rows("cuckoo") == rows("radix_tree") == rows("linear_probe") == rows("chained")
    empty = build.limit(0)
    assert all(joins.matches(empty, s, x).first().matches == 0 for x, (how, _) in joins.STRATEGIES.items() if how != "left_anti")
    joins.register("twice", "inner", lambda b, p: p.join(b, "key").unionAll(p.join(b, "key")))
    assert count("twice") == 2 * min(inner)
    del joins.STRATEGIES["twice"]
    with pytest.raises(ValueError):
        joins.register("odd", "cross", lambda b, p: p)
    assert joins.multiplicities(build, s).agg(F.sum("matches")).first()[0] == inner.pop()
    assert joins.upserted(build.where("key is not null"), "payload").count() == build.where("key is not null").select("key").distinct().count()


def test_ordering(spark):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(500)], "a long, b long")
    rows = sorted((r.a, r.b) for r in df.collect())
    got = ordering.ranked(df, "a", "b").collect()
    assert sorted((r["rank"], r.a, r.b) for r in got) == [(i, *x) for i, x in enumerate(rows)]
    run = {(r.a, r.b): r.t for r in ordering.running(df, ["a", "b"], t="b").collect()}
    top = {(r.a, r.b): r.m for r in ordering.running_max(df, ["a", "b"], "b", "m").collect()}
    total, most = 0, -1
    for x in rows:
        total, most = total + x[1], max(most, x[1])
        assert run[x] == total and top[x] == most
    assert ordering.ranked(df.limit(0), "a").count() == 0
    x = ordering.scan(df, ["a", "b"], before=True, rank="i", mins={"low": "b"}, xors={"fold": "b"}, sums={"sum": "b"}).orderBy("i").collect()
    low, fold, total = None, 0, 0
    for r, (a, b) in zip(x, rows, strict=True):
        assert (r.a, r.b, r.low, r.fold, r.sum) == (a, b, low, fold, total)
        low, fold, total = b if low is None else min(low, b), fold ^ b, total + b
    first = {r.key: (r.first, r["rows"]) for r in ordering.first_places(df, "a").collect()}
    assert first == {a: (sum(y < a for y, _ in rows), sum(y == a for y, _ in rows)) for a in {a for a, _ in rows}}
    ordering.release(spark)
    assert not ordering._kept


def test_hashes(spark):
    def plain(x):
        x &= 0xFFFFFFFF
        x = (x ^ x >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        x = (x ^ x >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        return x ^ x >> 16

    values = [0, 1, 2**31, 2**32 - 1, 2**40 + 7, 2**62]
    got = keys(spark, values).select("key", *[h(F.col("key")).alias(n) for n, h in hashing.HASHES.items()]).collect()
    for r in got:
        assert r.murmur32 == plain(r.key)
        assert r.mult_prime32 == ((r.key & 0xFFFFFFFF) ^ r.key >> 32) * 4294967291 & 0xFFFFFFFF
        assert 0 <= r.murmur64 < 2**62
        full = r.key
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            full = (full ^ full >> 33) * c % 2**64
        full ^= full >> 33
        assert r.fmix64 % 2**64 == full and r.mult_prime64 % 2**64 == r.key * (2**64 - 59) % 2**64 and r.fibonacci64 % 2**64 == r.key * 0x9E3779B97F4A7C15 % 2**64
    swapped = keys(spark, [1, -2, 2**62 + 5]).select("key", hashing.byte_swapped(F.col("key")).alias("s")).collect()
    assert all(r.s == int.from_bytes(r.key.to_bytes(8, "little", signed=True), "big", signed=True) for r in swapped)
    reduced = keys(spark, range(500)).select(*[f(hashing.murmur32(F.col("key")), 64).alias(n) for n, f in hashing.REDUCTIONS.items()])
    for n in hashing.REDUCTIONS:
        assert reduced.agg(F.min(n), F.max(n)).first()[1] < 64
    assert [hashing.next_pow2(n) for n in (1, 2, 3, 64, 65)] == [1, 2, 4, 64, 128]


def test_models_keep_their_bounds(spark):
    k = generators.normal(spark, 3000, seed=1)
    ranks = {r.key: r["rank"] for r in models.rank_model(k).collect()}
    for eps in (1.0, 32.0):
        pieces = models.segments(k, eps)
        got = models.predict_segments(k, pieces).collect()
        assert len(got) == len(ranks) and all(abs(r.predicted - ranks[r.key]) <= eps + 1e-6 for r in got)
        assert pieces.agg(F.sum("n")).first()[0] == len(ranks)
        again = models.segments(k.repartition(7), eps).collect()
        assert sorted(map(tuple, again)) == sorted(map(tuple, pieces.collect()))
    low, high = k.agg(F.min("key"), F.max("key")).first()
    rmi = models.fit_rmi(k, 50)
    error = {r.leaf: r.error for r in models.with_errors(rmi).collect()}
    for r in rmi.predict(rmi.placed, rmi.n).withColumn("leaf", models.root(F.col("key"), low, high, 50)).collect():
        assert abs(r.bucket - r["rank"]) <= error[r.leaf]
    small = sorted(map(tuple, rmi.model.collect()))
    models.SMALL, usual = 10, models.SMALL
    assert sorted(map(tuple, models.train_rmi(k, 50).collect())) == small
    models.SMALL = usual
    assert models.checked(leaves=0, eps=0.5, share=2.0) == {"leaves": 100, "eps": 16.0, "share": 0.01, "parts": 1} and models.checked(leaves=7, eps=2)["eps"] == 2.0
    with pytest.raises(TypeError):
        models.checked(leaves=1.5)
    table = models.radix_table(models.segments(k, 4.0), 6, low, high).collect()
    assert 0 < len(table) <= 64 and min(r.first_key for r in table) == low
    out = models.predict_rmi(k, models.train_rmi(k, 50), low, high, 50, 100).collect()
    assert all(0 <= r.bucket < 100 for r in out) and len(out) == len(ranks)
    assert models.train_rmi(spark.range(1).select(F.lit(7).cast("long").alias("key")), 4).count() == 4


def test_layouts(spark):
    k = spark.range(2000).select((F.col("id") * 3).alias("key"))
    placed = tables.linear_probe(k, hashing.mod(hashing.murmur32(F.col("key")), 2600)).collect()
    assert len({r.actual for r in placed}) == 2000 and all(r.actual >= r.ideal for r in placed)
    table, total = set(), 0
    for r in sorted(placed, key=lambda r: (r.key * 7919) % 10007):  # any order of inserts moves keys as far in all
        at = r.ideal
        while at in table:
            at += 1
        table.add(at)
        total += at - r.ideal
    assert total == sum(r.actual - r.ideal for r in placed) and table == {r.actual for r in placed}
    empty = {r.distance: r.slots for r in stats.distance_to_empty(spark.createDataFrame(placed)).collect()}
    assert sum(empty.values()) == 2000
    chained = tables.chained(k, hashing.mod(hashing.murmur32(F.col("key")), 300), 4)
    assert chained.select("bucket", "chain_pos", "slot").distinct().count() == 2000 and chained.agg(F.max("slot")).first()[0] == 3
    hist = stats.occupancy(chained, 300).agg(F.sum("buckets"), F.sum(F.col("keys") * F.col("buckets"))).first()
    assert tuple(hist) == (300, 2000)
    assert tables.directory_size(1000, 1, 100) == 2001 and tables.directory_size(1000, 1, 10050) == 501
    by_four = tables.linear_probe(k, hashing.mod(hashing.murmur32(F.col("key")), 700), 4).collect()
    assert len({r.actual for r in by_four}) == 2000 and all(r.actual // 4 >= r.ideal for r in by_four)
    filled = {}
    for r in by_four:
        filled.setdefault(r.actual // 4, set()).add(r.actual)
    assert all(len(filled[b]) == 4 for r in by_four for b in range(r.ideal, r.actual // 4))
    held = {r.first: (r.last, r["keys"]) for r in tables.runs(spark.createDataFrame(placed)).collect()}
    assert all(last - first + 1 == n and first - 1 not in table and last + 1 not in table for first, (last, n) in held.items())
    h = hashing.murmur32(F.col("key"))
    both = lambda n: tables.cuckoo_candidates(k, hashing.mod(h, n), hashing.mod(hashing.murmur32(h.bitwiseXOR(F.lit(408957))), n), n)
    primary = {}
    for kicking, buckets in (("balanced", 700), ("biased", 1500), ("unbiased", 2500)):
        c = tables.cuckoo_layout(both(buckets), 4, kicking, bias=5).collect()
        assert len({r.key for r in c}) == len(c) == 2000 and all(r.bucket == (r.b1 if r.is_primary else r.b2) for r in c)
        fill = {}
        for r in c:
            fill[r.bucket] = fill.get(r.bucket, 0) + 1
        assert max(fill.values()) <= 4
        primary[kicking] = sum(r.is_primary for r in c)
    assert min(primary.values()) > 1000
    with pytest.raises(RuntimeError, match="no place found"):
        tables.cuckoo_layout(both(300), 4, most_rounds=5)
    with pytest.raises(ValueError):
        tables.cuckoo_layout(both(300), 4, "gentle")
    ratio = stats.primary_ratio_of(tables.cuckoo_primary(both(700), 4), k.where("key < 300").unionAll(k.limit(1))).first().ratio
    assert 0 < ratio <= 1
    n_bytes = tables.open_bytes(k, 700, 4, model_bytes=tables.model_bytes(10)).first()
    assert n_bytes.table_bytes == 700 * 64 + 176 and n_bytes.bits_per_key == n_bytes.table_bytes * 8 / 2000


def test_sorting_and_sets(spark):
    a = spark.createDataFrame([(v,) for v in (5, 3, 3, 9, 5, 5)], "key long")
    assert [r.key for r in sorting.merge(a, a).collect()] == sorted([5, 3, 3, 9, 5, 5] * 2)
    assert [r.key for r in sorting.dedupe(a).collect()] == [3, 5, 9]
    assert sorted(r.key for r in sorting.expanded(sorting.compressed(a)).collect()) == [3, 3, 5, 5, 5, 9]
    assert [tuple(r) for r in sorting.heavy_hitters(a, 3).collect()] == [(5, 3)]
    assert sorted(r.key for r in sorting.shuffled(a, 4).collect()) == [3, 3, 5, 5, 5, 9]
    parts = sorting.cdf_partition(a, F.col("key") % 2, 2)
    assert parts.count() == 6
    hot = spark.range(1000).select(F.lit(7).cast("long").alias("key")).unionAll(spark.range(40).select(F.col("id").alias("key")))
    dealt = sorting.cdf_partition(hot, F.col("key") % 20, 20)
    assert dealt.count() == 1040 and dealt.where("part = 7").select("piece").distinct().count() > 4 and dealt.where("part <> 7").agg(F.max("piece")).first()[0] == 0
    assert sets.union_all(a, a).count() == 12 and sets.with_holes(a, a.limit(0)).count() == 6
    names = spark.createDataFrame([("a",), ("b",), ("b",)], "name string")
    assert sets.except_names(names, names.where("name = 'a'")).count() == 2


def test_generators(spark):
    n = 2000
    for df in (generators.sequential(spark, n), generators.gapped(spark, n), generators.uniform(spark, n), generators.normal(spark, n), generators.holes(spark, n)):
        assert df.count() == df.distinct().count() <= n
    assert generators.holes(spark, n).agg(F.max("key")).first()[0] <= 2200
    assert generators.normal(spark, n).agg(F.max("key")).first()[0] <= 120 << 40
    k = generators.uniform(spark, n)
    for kind in ("uniform", "exponential_sorted", "exponential_random"):
        p = generators.probes(k, 3000, 0.7, kind, 2)
        assert p.count() == 3000
        assert 0.65 < p.join(k, "key", "left_semi").count() / 3000 < 0.75
    q = generators.range_queries(k, 200)
    assert q.where("lo <= hi").count() == 200
    assert generators.foreign_keys(spark, 10, 4).groupBy("key").count().agg(F.max("count")).first()[0] == 3
    for kind in ("normal", "uniform", "exponential", "lognormal"):
        assert generators.skewed(spark, n, kind, 50.0).where("key >= 0").count() == n
    assert generators.cached("u", generators.uniform, spark, 10) is generators.cached("u", generators.uniform, spark, 10)
    assert generators.cached("u", generators.uniform, spark, 10, probe_side=True) is not generators.cached("u", generators.uniform, spark, 10)
    generators.uncached(spark)
    assert not [a for a in generators._cache if a[0] == spark.sparkContext.applicationId]
    u = generators.unique32(spark, n)
    assert u.distinct().count() == n and u.agg(F.max("key")).first()[0] < 2**32
    assert [tuple(r) for r in generators.tuples(spark, [5, 3]).collect()] == [(5, 0), (3, 1)]
    assert [r.key for r in generators.de_sentinel(generators.tuples(spark, [5, 9]), 9).collect()] == [5, 8]
    assert [r.payload for r in generators.self_payload(generators.tuples(spark, [5, 9])).collect()] == [5, 9]
    assert generators.osm(spark.range(1).select(F.lit(2**62 + 2**61).alias("key"))).first().key == 2**61


def test_sources(spark, tmp_path, golden):
    relations.write_text(golden, str(tmp_path / "r"), 2)
    assert sorted(map(tuple, relations.read_text(spark, str(tmp_path / "r")).collect())) == ROWS
    (tmp_path / "bad.txt").write_text("#KEY, VAL\n1,2\n")
    with pytest.raises(Exception):
        relations.read_text(spark, str(tmp_path / "bad.txt")).collect()
    relations.materialize(golden, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m_sorted")).count() == 6
    relations.write_csv(golden, str(tmp_path / "c"))
    assert sorted(map(tuple, relations.read_csv(spark, str(tmp_path / "c"), ["key", "payload"]).collect())) == ROWS
    assert relations.load_text(spark, str(tmp_path / "r"), 4).count() == 4
    with pytest.raises(ValueError):
        relations.load_text(spark, str(tmp_path / "r"), 7)
    kept = golden.select("key").persist()
    kept.count()
    relations.free(kept)
    assert not kept.is_cached
    relations.write_json(spark.createDataFrame([("a", 2.0), ("a", 1.0), ("b", 3.0)], "name string, cpu_time double"), str(tmp_path / "j"))
    assert sorted((r.name, r.cpu_time) for r in spark.read.json(str(tmp_path / "j")).collect()) == [("a", 1.0), ("b", 3.0)]
    (tmp_path / "b.json").write_text('{"context": {"num_cpus": 4}, "benchmarks": [{"name": "A<1, 10>", "label": "m:d", "cpu_time": 2.0, "data_elem_count": 1000000.0}]}')
    r = reports.labels(reports.derived(relations.read_benchmarks(spark, str(tmp_path / "b.json")))).first()
    assert (r.method, r.dataset, r.probe_distribution, r.range_size, r.ns_per_key) == ("m", "d", "-", "10", 2e-6)


@pytest.mark.parametrize("width", [4, 8])
def test_binary_keys(spark, tmp_path, width):
    top = 2 ** (8 * width) - 1
    values = [7, 1, 7, top]
    path = tmp_path / "keys"
    path.write_bytes(len(values).to_bytes(8, "little") + b"".join(v.to_bytes(width, "little") for v in values))
    got = binary_keys.read_keys(spark, str(path), width, unsigned=True).collect()
    assert [int(r.key) for r in got] == [1, 7, top]
    assert binary_keys.read_keys(spark, str(tmp_path / "none"), missing="empty").count() == 0
    with pytest.raises(Exception):
        binary_keys.read_keys(spark, str(tmp_path / "none")).count()
    binary_keys.write_keys(spark.range(5).withColumnRenamed("id", "key"), str(tmp_path / "w"), width)
    assert [r.key for r in binary_keys.read_keys(spark, str(tmp_path / "w"), width).collect()] == [0, 1, 2, 3, 4]
    binary_keys.write_keys(binary_keys.read_keys(spark, str(path), width, unsigned=True).unionAll(spark.range(20_000).select(F.col("id").cast("decimal(20,0)"))), str(tmp_path / "x"), width)
    back = binary_keys.read_keys(spark, str(tmp_path / "x"), width, dedupe=False, unsigned=True)
    assert back.count() == 20_003 and int(back.agg(F.max("key")).first()[0]) == top
    if width == 8:
        (tmp_path / "wiki_ts_200M_uint64").write_bytes((3).to_bytes(8, "little") + b"".join(v.to_bytes(8, "little") for v in (9, 4, 9)))
        assert sorted(r.key for r in generators.stored(spark, str(tmp_path), "wiki", 2).collect()) == [4, 9]
        with pytest.raises(KeyError):
            generators.stored(spark, str(tmp_path), "moon", 2)


def test_stream_of_probes(spark, tmp_path, golden):
    keys(spark, [1, 2, 5, 5]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("probe_id long, key long").parquet(str(tmp_path / "in"))
    for how, want in (("left_semi", [1, 5, 5]), ("left_anti", [2])):
        q = probe.probe(stream, golden, how).writeStream.format("memory").queryName(f"s_{how}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(r.key for r in spark.table(f"s_{how}").collect()) == want


def test_reports(spark):
    df = spark.createDataFrame([("a", 2.0, 5.0), ("a", 1.0, 6.0), ("b", 3.0, 1.0), ("c", 3.0, 9.0)], "name string, cpu_time double, bits double")
    assert {(r.name, r.cpu_time) for r in reports.best_per_name(df).collect()} == {("a", 1.0), ("b", 3.0), ("c", 3.0)}
    assert {tuple(r) for r in reports.pareto(df, "cpu_time", "bits").select("name", "cpu_time").collect()} == {("a", 2.0), ("a", 1.0), ("b", 3.0)}
    shown = spark.createDataFrame([("Prefetched x", "b", 1.0), ("RMI", "a", 2.0), ("RMI", "a", 1.0)], "method string, name string, point_lookup_percent double")
    assert [(r.name, r.point_lookup_percent) for r in reports.by_share(reports.visible(shown)).collect()] == [("a", 1.0), ("a", 2.0)]
    r = reports.median_and_min(df, "name", "cpu_time").where("name = 'a'").first()
    assert r.least == 1.0
    assert spark.range(1).select(reports.magnitude(F.lit(1e8)).alias("m")).first().m == "100M"
