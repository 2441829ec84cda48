"""Registered queries over the driver's tables, with SQL for the same rows.

R is ``orders`` (key o_orderkey, payload the price in cents), S the order keys of
``lineitem``; keys of an uneven distribution are the distinct prices in cents, times
are those of ``events`` in microseconds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import models as M
from ..operators import indexes, joins, lookup, ordering, reports, sets, sorting, stats, tables
from ..sources import generators as G
from ..streaming import probe as stream_probe
from . import grids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BUCKETS = 1000
LEAVES = 100


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def r(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), cents("o_totalprice").alias("payload"))


def s(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"))


def s_missing(spark, d) -> DataFrame:
    """Probes of which some miss: order keys doubled."""
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 2).alias("key"))


def prices(spark, d) -> DataFrame:
    return M.key_set(table(spark, d, "orders").select(cents("o_totalprice").alias("key")))


_R = "r AS (SELECT o_orderkey AS key, CAST(round(o_totalprice * 100) AS BIGINT) AS payload FROM orders)"
_S = "s AS (SELECT l_orderkey AS key FROM lineitem)"
_S2 = "s AS (SELECT l_orderkey * 2 AS key FROM lineitem)"
_K = "k AS (SELECT DISTINCT CAST(round(o_totalprice * 100) AS BIGINT) AS key FROM orders)"
_SEMI = f"WITH {_R}, {_S2} SELECT count(*) AS matches FROM s WHERE key IN (SELECT key FROM r)"
_INNER = f"WITH {_R}, {_S} SELECT count(*) AS matches FROM s JOIN r USING (key)"

# Joins

for _strategy in ("chained", "linear_probe", "cuckoo", "gapped", "radix_tree"):
    query(_SEMI, f"join_{_strategy}_semi")(lambda spark, d, x=_strategy: joins.matches(r(spark, d), s_missing(spark, d), x))
for _strategy in ("hash", "sort_merge", "learned_index", "css_tree", "learned_sort_merge", "auto"):
    query(_INNER, f"join_{_strategy}_inner")(lambda spark, d, x=_strategy: joins.matches(r(spark, d), s(spark, d), x))


@query(f"WITH {_R}, {_S2} SELECT count(*) AS matches FROM s WHERE key NOT IN (SELECT key FROM r)")
def join_miss_anti(spark, d):
    return joins.matches(r(spark, d), s_missing(spark, d), "miss")


@query(_SEMI)
def join_hash_bucket_semi(spark, d):
    return joins.bucketed_semi(r(spark, d), s_missing(spark, d), H.mod(H.murmur32(F.col("key")), BUCKETS)).agg(F.count("*").alias("matches"))


def line_prices(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(cents("l_extendedprice").alias("key"))


_UNEVEN = f"WITH {_K}, p AS (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS key FROM lineitem) SELECT count(*) AS matches FROM p WHERE key IN (SELECT key FROM k)"


@query(_UNEVEN)
def join_learned_bucket_semi(spark, d):
    """Both sides by the bucket that a model of the keys predicts."""
    rmi = M.fit_rmi(prices(spark, d), LEAVES)
    bucket = lambda df: rmi.predict(df, BUCKETS).select("bucket", "key")
    return bucket(line_prices(spark, d)).join(bucket(rmi.placed.select("key")), ["bucket", "key"], "left_semi").agg(F.count("*").alias("matches"))


for _strategy in ("linear_probe", "gapped", "radix_tree"):
    query(_UNEVEN, f"join_{_strategy}_uneven_semi")(lambda spark, d, x=_strategy: joins.matches(prices(spark, d), line_prices(spark, d), x))
query(_UNEVEN.replace("WHERE key IN (SELECT key FROM k)", "JOIN q USING (key)").replace(f"WITH {_K}", "WITH q AS (SELECT CAST(round(o_totalprice * 100) AS BIGINT) AS key FROM orders)"), "join_learned_index_duplicates")(lambda spark, d: joins.matches(table(spark, d, "orders").select(cents("o_totalprice").alias("key"), F.col("o_orderkey").alias("payload")), line_prices(spark, d), "learned_index"))


@query(f"WITH {_R}, {_S2}, k AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS rank FROM r) SELECT key, rank, count(*) AS probes FROM s JOIN k USING (key) GROUP BY ALL")
def join_rank_semi(spark, d):
    return s_missing(spark, d).join(M.rank_model(M.key_set(r(spark, d))), "key").groupBy("key", "rank").agg(F.count("*").alias("probes"))


@query("SELECT a.key, CAST(a.n * b.n AS BIGINT) AS matches FROM (SELECT l_partkey AS key, count(*) AS n FROM lineitem GROUP BY 1) a JOIN (SELECT p_partkey AS key, count(*) AS n FROM part GROUP BY 1) b USING (key)")
def join_fk_multiplicity(spark, d):
    return joins.multiplicities(table(spark, d, "part").select(F.col("p_partkey").alias("key")), table(spark, d, "lineitem").select(F.col("l_partkey").alias("key")))


_DUP = "SELECT o_custkey AS key, CAST(round(o_totalprice * 100) AS BIGINT) AS payload, o_orderkey AS seq FROM orders"


@query(f"WITH b AS (SELECT key, max(seq) AS seq, arg_max(payload, seq) AS payload FROM ({_DUP}) GROUP BY key) SELECT c_custkey AS key, seq, payload FROM customer JOIN b ON c_custkey = key")
def join_upsert_last(spark, d):
    build = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), cents("o_totalprice").alias("payload"), F.col("o_orderkey").alias("seq"))
    return joins.join(build, table(spark, d, "customer").select(F.col("c_custkey").alias("key")), upsert_by="seq")


@query(f"WITH {_R}, {_S} SELECT key % 8 AS part, count(*) AS matches, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM s JOIN r USING (key) GROUP BY 1")
def join_partition_counts(spark, d):
    return joins.partition_counts(r(spark, d), s(spark, d), F.col("key") % 8)


@query("SELECT count(*) AS matches FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND l_shipdate > TIMESTAMP '1995-03-15' AND o_orderdate < TIMESTAMP '1995-03-15'")
def join_tpch_q3_keys(spark, d):
    day = F.lit("1995-03-15").cast("timestamp_ntz")
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"))
    o = joins.join(c, table(spark, d, "orders").where(F.col("o_orderdate") < day).select(F.col("o_custkey").alias("key"), "o_orderkey")).select(F.col("o_orderkey").alias("key"))
    return joins.matches(o, table(spark, d, "lineitem").where(F.col("l_shipdate") > day).select(F.col("l_orderkey").alias("key")))


@query("SELECT n_name, count(*) AS matches FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey WHERE r_name = 'ASIA' GROUP BY n_name")
def join_tpch_q5_keys(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    supp = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("key"), "n_name")
    return joins.join(supp, table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"))).groupBy("n_name").agg(F.count("*").alias("matches"))


@query("SELECT count(*) AS matches FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size < 10")
def join_tpch_q9_keys(spark, d):
    return joins.matches(table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("key")), table(spark, d, "lineitem").select(F.col("l_partkey").alias("key")))


@query("SELECT count(*) AS matches FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 150)")
def join_tpch_q18_keys(spark, d):
    big = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.sum("l_quantity").alias("q")).where("q > 150")
    return joins.matches(big, table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), "chained")


# Look-ups. Probe i looks for key 3 i mod twice the number of orders.

_P = "p AS (SELECT o_orderkey AS probe_id, (o_orderkey * 3) % (2 * (SELECT count(*) FROM orders)) AS key FROM orders)"


def probes(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("probe_id"), ((F.col("o_orderkey") * 3) % (2 * o.count())).alias("key"))


def _next_sql(n: int) -> str:
    return f"WITH {_R}, {_P}, k AS (SELECT payload, key, row_number() OVER (ORDER BY key) - 1 AS pos FROM r), f AS (SELECT pos, key, bit_xor(payload) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS folded FROM k) SELECT probe_id, p.key, CAST(coalesce(f.folded, 0) AS BIGINT) AS folded FROM p ASOF LEFT JOIN f ON p.key <= f.key"


@query(f"WITH {_R}, {_P} SELECT probe_id, p.key, CASE WHEN r.key IS NULL THEN 0 ELSE 1 END AS found FROM p LEFT JOIN r ON p.key = r.key")
def lookup_point(spark, d):
    return lookup.point(r(spark, d), probes(spark, d))


@query(f"WITH {_R}, {_P} SELECT probe_id, p.key, payload FROM p LEFT JOIN r ON p.key = r.key")
def lookup_payload(spark, d):
    return lookup.payload(r(spark, d), probes(spark, d))


for _n in (10, 20):
    query(_next_sql(_n), f"lookup_next{_n}_xor")(lambda spark, d, n=_n: lookup.next_xor(r(spark, d), probes(spark, d), n))


@query(f"WITH m AS ({_next_sql(10)}), {_R} SELECT probe_id, m.key, CAST(CASE WHEN probe_id % 100 <= 40 THEN coalesce(payload, 0) ELSE folded END AS BIGINT) AS folded FROM m LEFT JOIN r ON m.key = r.key")
def lookup_mixed(spark, d):
    return lookup.mixed(r(spark, d), probes(spark, d), 40)


_RN = "r AS (SELECT nullif(o_orderkey, 7 * (o_orderkey // 7)) AS key, CAST(round(o_totalprice * 100) AS BIGINT) AS payload FROM orders)"
_PN = "p AS (SELECT o_orderkey AS probe_id, nullif(o_orderkey, 5 * (o_orderkey // 5)) AS key FROM orders)"


def with_nulls(c: str, n: int):
    """A key that is null for every ``n``-th number."""
    return F.when(F.col(c) % n != 0, F.col(c))


@query(_next_sql(10).replace(_R, _RN).replace(_P, _PN).replace("FROM r)", "FROM r WHERE key IS NOT NULL)"))
def lookup_next10_xor_nulls(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(with_nulls("o_orderkey", 7).alias("key"), cents("o_totalprice").alias("payload"))
    return lookup.next_xor(rows, o.select(F.col("o_orderkey").alias("probe_id"), with_nulls("o_orderkey", 5).alias("key")), 10)


@query(f"WITH {_R}, {_P}, k AS (SELECT key, payload, row_number() OVER (ORDER BY key) - 1 AS pos FROM r), f AS (SELECT probe_id, pos FROM p ASOF JOIN k ON p.key <= k.key), g AS (SELECT probe_id, pos, unnest(range(0, 5)) AS step FROM f) SELECT probe_id, step, k.key, payload FROM g JOIN k ON k.pos = g.pos + g.step")
def lookup_iterate(spark, d):
    return lookup.iterate(r(spark, d), probes(spark, d), 5).select("probe_id", F.col("step").cast("long").alias("step"), "key", "payload")


def range_queries(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("query_id"), F.col("o_orderkey").alias("lo"), (F.col("o_orderkey") + F.expr("shiftleft(1L, cast(o_orderkey % 11 as int))")).alias("hi"))


def parts_relation(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), cents("l_extendedprice").alias("payload"))


_RANGES = "WITH q AS (SELECT o_orderkey AS query_id, o_orderkey AS lo, o_orderkey + (1 << (o_orderkey % 11)) AS hi FROM orders), c AS (SELECT l_orderkey AS key, count(*) AS n, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS v FROM lineitem GROUP BY 1), a AS (SELECT key, sum(n) OVER (ORDER BY key) AS n, sum(v) OVER (ORDER BY key) AS v FROM c) SELECT query_id, lo, hi, CAST(coalesce(b.n, 0) - coalesce(a.n, 0) AS BIGINT) AS n, CAST(coalesce(b.v, 0) - coalesce(a.v, 0) AS BIGINT) AS total FROM (q ASOF LEFT JOIN a ON q.lo > a.key) ASOF LEFT JOIN a AS b ON q.hi >= b.key"


@query(_RANGES)
def range_count_sum_prefix(spark, d):
    return lookup.ranges(parts_relation(spark, d), range_queries(spark, d))


@query(_RANGES)
def range_count_sum_band(spark, d):
    return lookup.ranges_by_band(parts_relation(spark, d), range_queries(spark, d), 64)


_ODD_RANGES = _RANGES.replace("o_orderkey AS lo, o_orderkey + (1 << (o_orderkey % 11)) AS hi", "nullif(o_orderkey, 5 * (o_orderkey // 5)) AS lo, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - 1 WHEN o_orderkey % 11 = 1 THEN o_orderkey + 10000 ELSE nullif(o_orderkey, 7 * (o_orderkey // 7)) END AS hi").replace("SELECT query_id, lo, hi, CAST(coalesce(b.n, 0) - coalesce(a.n, 0) AS BIGINT) AS n, CAST(coalesce(b.v, 0) - coalesce(a.v, 0) AS BIGINT) AS total", "SELECT query_id, lo, hi, CAST(CASE WHEN lo <= hi THEN coalesce(b.n, 0) - coalesce(a.n, 0) ELSE 0 END AS BIGINT) AS n, CAST(CASE WHEN lo <= hi THEN coalesce(b.v, 0) - coalesce(a.v, 0) ELSE 0 END AS BIGINT) AS total")


def odd_ranges(spark, d) -> DataFrame:
    """Ranges with null, crossed and far bounds."""
    k = F.col("o_orderkey")
    hi = F.when(k % 3 == 0, k - 1).when(k % 11 == 1, k + 10000).otherwise(with_nulls("o_orderkey", 7))
    return table(spark, d, "orders").select(k.alias("query_id"), with_nulls("o_orderkey", 5).alias("lo"), hi.alias("hi"))


@query(_ODD_RANGES)
def range_odd_prefix(spark, d):
    return lookup.ranges(parts_relation(spark, d), odd_ranges(spark, d))


@query(_ODD_RANGES)
def range_odd_band(spark, d):
    return lookup.ranges_by_band(parts_relation(spark, d), odd_ranges(spark, d), 64)


@query(f"SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(total) AS BIGINT) AS total FROM ({_RANGES})")
def range_batch_total(spark, d):
    return lookup.ranges(parts_relation(spark, d), range_queries(spark, d)).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


# Hash functions

_HASH = H.murmur32_sql("o_orderkey")


@query(f"SELECT o_orderkey AS key, {_HASH} AS h FROM orders")
def hash_murmur32(spark, d):
    return r(spark, d).select("key", H.murmur32(F.col("key")).alias("h"))


@query(f"SELECT ({_HASH}) * {BUCKETS} >> 32 AS bucket, count(*) AS keys FROM orders GROUP BY 1")
def hash_alt_mod_bucket(spark, d):
    return r(spark, d).groupBy(H.fast_range(H.murmur32(F.col("key")), BUCKETS).alias("bucket")).agg(F.count("*").alias("keys"))


@query(f"SELECT (({_HASH}) & 16368) >> 4 AS bucket, count(*) AS keys FROM orders GROUP BY 1")
def hash_mask_bucket(spark, d):
    return r(spark, d).groupBy(H.mask(H.murmur32(F.col("key")), 10, 4).alias("bucket")).agg(F.count("*").alias("keys"))


def _times_sql(x: str, c: int) -> str:
    return f"(((({x}) & 65535) * {c}) + (((({x}) >> 16) * {c}) & 65535) * 65536) & 4294967295"


_PRICE32 = "xor(key & 4294967295, key >> 32)"


@query(f"WITH {_K} SELECT key, {_times_sql(_PRICE32, 4294967291)} AS prime, {_times_sql(_PRICE32, 0x9E3779B1)} AS fibonacci FROM k")
def hash_multiplicative(spark, d):
    return prices(spark, d).select("key", H.mult_prime32(F.col("key")).alias("prime"), H.fibonacci32(F.col("key")).alias("fibonacci"))


@query(f"WITH {_K} SELECT key, ((({H.murmur32_sql(_PRICE32)}) & 1073741823) << 32) | ({H.murmur32_sql('xor(key, 2654435769)')}) AS h FROM k")
def hash_murmur64(spark, d):
    return prices(spark, d).select("key", H.murmur64(F.col("key")).alias("h"))


@query(f"WITH {_R}, {H.steps64_sql('r', H.xxhash64_steps())} SELECT ((h % {BUCKETS}) + {BUCKETS}) % {BUCKETS} AS bucket, count(*) AS keys FROM hashed GROUP BY 1")
def hash_xxhash64_bucket(spark, d):
    return r(spark, d).groupBy(H.mod(H.HASHES["xxhash64"](F.col("key")), BUCKETS).alias("bucket")).agg(F.count("*").alias("keys"))


for _name, _steps in (("fmix64", H.fmix64_steps()), ("mult_prime64", H.mult64_steps(2**64 - 59)), ("fibonacci64", H.mult64_steps(0x9E3779B97F4A7C15))):
    query(f"WITH {_K}, {H.steps64_sql('k', _steps)} SELECT key, h FROM hashed", f"hash_{_name}")(lambda spark, d, x=_name: prices(spark, d).select("key", H.HASHES[x](F.col("key")).alias("h")))


_BYTES = " || ".join(f"lpad(to_hex((key >> {8 * i}) & 255), 2, '0')" for i in range(8))


@query(f"WITH {_K} SELECT key, {_BYTES} AS swapped FROM k")
def hash_byte_swapped(spark, d):
    return prices(spark, d).select("key", F.lpad(F.hex(H.byte_swapped(F.col("key"))), 16, "0").alias("swapped"))


# Models

_RANK = f"{_K}, b AS (SELECT count(*) AS n, min(key) AS lo, max(key) AS hi FROM k), y AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS rank FROM k)"
_ROOT = f"CAST(least(greatest(floor(CAST(key - lo AS DOUBLE) * ({LEAVES - 1}e0 / (hi - lo))), 0), {LEAVES - 1}) AS BIGINT)"
_RMI = f"""{_RANK}, t AS (SELECT key, rank / CAST(n AS DOUBLE) AS y, {_ROOT} AS leaf FROM y, b),
g AS (SELECT leaf, count(*) AS n, min(key) AS x0, min(y) AS y0, max(key) AS x1, max(y) AS y1 FROM t GROUP BY leaf),
w AS (SELECT m.leaf, coalesce(n, 0) AS n, x0, y0, x1, y1, max(x1) OVER p AS px, coalesce(max(y1) OVER p, 0e0) AS py FROM (SELECT unnest(range(0, {LEAVES})) AS leaf) m LEFT JOIN g USING (leaf) WINDOW p AS (ORDER BY m.leaf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, CAST(CASE WHEN leaf = 0 THEN x1 - x0 ELSE x1 - px END AS DOUBLE) AS width, CASE WHEN leaf = 0 THEN y1 WHEN leaf = {LEAVES - 1} THEN 1e0 - py ELSE y1 - py END AS rise FROM w),
u AS (SELECT *, (leaf = 0 AND n < 2) OR n = 0 OR coalesce(width <= 0, false) AS flat FROM v),
z AS (SELECT *, CASE WHEN flat THEN 0e0 ELSE rise / width END AS slope FROM u),
rmi AS (SELECT leaf, slope, CASE WHEN flat THEN CASE WHEN leaf = 0 THEN 0e0 WHEN leaf = {LEAVES - 1} THEN 1e0 ELSE py END WHEN leaf = 0 THEN y0 - slope * CAST(x0 AS DOUBLE) ELSE py - slope * CAST(px AS DOUBLE) END AS intercept FROM z),
pred AS (SELECT key, rank, slope * CAST(key AS DOUBLE) + intercept AS cdf FROM (SELECT key, rank, {_ROOT} AS leaf FROM y, b) JOIN rmi USING (leaf)),
hit AS (SELECT key, rank, cdf, CAST(least(greatest(floor(cdf * {BUCKETS}), 0), {BUCKETS - 1}) AS BIGINT) AS bucket FROM pred)"""


def predicted(spark, d, n: int = BUCKETS) -> DataFrame:
    rmi = M.fit_rmi(prices(spark, d), LEAVES)
    return rmi.predict(rmi.placed, n)


@query(f"WITH {_RANK} SELECT key, rank FROM y")
def model_rank(spark, d):
    return M.rank_model(prices(spark, d))


@query(f"WITH {_RMI} SELECT leaf, round(slope, 15) AS slope, round(intercept, 9) AS intercept FROM rmi")
def model_rmi_leaves(spark, d):
    return M.train_rmi(prices(spark, d), LEAVES).select("leaf", F.round("slope", 15).alias("slope"), F.round("intercept", 9).alias("intercept"))


@query(f"WITH {_RMI} SELECT key, rank, bucket FROM hit")
def model_rmi_predict(spark, d):
    return predicted(spark, d).select("key", "rank", "bucket")


@query(f"WITH {_RMI} SELECT round(max(abs(cdf * n - rank)), 6) AS worst, round(avg(abs(cdf * n - rank)), 6) AS mean FROM hit, b")
def model_rmi_error(spark, d):
    rmi = M.fit_rmi(prices(spark, d), LEAVES)
    error = F.abs(F.col("cdf") * rmi.n - F.col("rank"))
    return rmi.predict(rmi.placed, BUCKETS).agg(F.round(F.max(error), 6).alias("worst"), F.round(F.avg(error), 6).alias("mean"))


@query(f"WITH {_RMI}, e AS (SELECT leaf, max(abs(CAST(least(greatest(floor(cdf * n), 0), n - 1) AS BIGINT) - rank)) AS error FROM (SELECT hit.*, {_ROOT} AS leaf, n FROM hit, b) GROUP BY leaf) SELECT leaf, CAST(coalesce(error, 0) AS BIGINT) AS error FROM rmi LEFT JOIN e USING (leaf)")
def model_rmi_leaf_errors(spark, d):
    return M.with_errors(M.fit_rmi(prices(spark, d), LEAVES)).select("leaf", "error")


@query(f"WITH {_RMI} SELECT CAST(max(least(greatest(floor(cdf * n), 0), n - 1)) AS BIGINT) AS most FROM hit, b")
def model_max_guess(spark, d):
    rmi = M.fit_rmi(prices(spark, d), LEAVES)
    return stats.max_guess(rmi.predict(rmi.placed, rmi.n))


_BOTH = "u AS (SELECT CAST(round(o_totalprice * 100) AS BIGINT) AS key FROM orders UNION ALL SELECT CAST(round(l_extendedprice * 100) AS BIGINT) FROM lineitem)"


@query(f"WITH {_BOTH}, b AS (SELECT min(key) AS lo, max(key) AS hi FROM u), y AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS rank FROM u), t AS (SELECT {_ROOT} AS leaf, key, rank FROM y, b) SELECT leaf, count(*) AS keys, max(rank) AS last FROM t GROUP BY leaf")
def model_rmi_two_relations(spark, d):
    """What the leaves of one model of two relations hold."""
    rmi = M.fit_both(table(spark, d, "orders").select(cents("o_totalprice").alias("key")), line_prices(spark, d), LEAVES)
    return rmi.placed.groupBy(M.root(F.col("key"), rmi.low, rmi.high, LEAVES).alias("leaf")).agg(F.count("*").alias("keys"), F.max("rank").alias("last"))


def _pieces_sql(eps: int) -> str:
    """The largest aligned stretches of ranks whose chord is within ``eps``, by trying all levels."""
    least = int(math.log2(eps + 1))
    return f"""{_RANK}, lv AS (SELECT level FROM (SELECT unnest(range({least}, 40)) AS level), b WHERE level = {least} OR (CAST(1 AS BIGINT) << (level - 1)) < n),
every AS (SELECT key, rank, level, rank >> level AS i FROM y, lv),
ends AS (SELECT level, i, min(key) AS x0, max(key) AS x1, min(rank) AS y0, max(rank) AS y1, CASE WHEN max(key) > min(key) THEN CAST(max(rank) - min(rank) AS DOUBLE) / (max(key) - min(key)) ELSE 0e0 END AS slope FROM every GROUP BY ALL),
fits AS (SELECT level, i FROM every JOIN ends USING (level, i) GROUP BY ALL HAVING max(abs(y0 + slope * (key - x0) - rank)) <= {eps}),
pieces AS (SELECT x0 AS first_key, slope, y0 AS first_rank, y1 - y0 + 1 AS n FROM fits f JOIN ends USING (level, i) WHERE NOT EXISTS (SELECT 1 FROM fits g WHERE g.level > f.level AND g.i = f.i >> (g.level - f.level)))"""


@query(f"WITH {_pieces_sql(16)} SELECT first_key, round(slope, 12) AS slope, first_rank, n FROM pieces")
def model_pgm(spark, d):
    return M.segments(prices(spark, d), 16.0).select("first_key", F.round("slope", 12).alias("slope"), "first_rank", "n")


@query(f"WITH {_pieces_sql(4)}, w AS (SELECT min(first_key) AS lo, (SELECT hi FROM b) AS hi FROM pieces) SELECT (first_key - lo) >> greatest(0, CAST(floor(log2(hi - lo)) AS INTEGER) + 1 - 10) AS prefix, min(first_key) AS first_key FROM pieces, w GROUP BY 1")
def model_radix_spline(spark, d):
    """The radix table over the pieces of a spline with an error of four places."""
    keys = prices(spark, d)
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    return M.radix_table(M.segments(keys, 4.0), 10, low, high)


@query(f"WITH {_RANK}, s AS (SELECT key AS first_key, rank AS first_rank, lead(rank) OVER w AS r1, lead(key) OVER w AS k1, (n + 63) // 64 AS step, n FROM y, b WHERE rank % ((n + 63) // 64) = 0 WINDOW w AS (ORDER BY key)) SELECT first_key, round(coalesce(CAST(r1 - first_rank AS DOUBLE) / (k1 - first_key), 0e0), 12) AS slope, first_rank, least(step, n - first_rank) AS n FROM s")
def model_spline(spark, d):
    return M.spline(prices(spark, d), 64).select("first_key", F.round("slope", 12).alias("slope"), "first_rank", "n")


# Table layouts and statistics

_B = f"({_HASH}) % {BUCKETS}"


def bucket():
    return H.mod(H.murmur32(F.col("key")), BUCKETS)


@query(f"SELECT key, bucket, (rn - 1) // 4 AS chain_pos, (rn - 1) % 4 AS slot FROM (SELECT key, bucket, row_number() OVER (PARTITION BY bucket ORDER BY key) AS rn FROM (SELECT o_orderkey AS key, {_B} AS bucket FROM orders))")
def table_chained_layout(spark, d):
    return tables.chained(r(spark, d).select("key"), bucket(), 4)


_LAYOUT = "SELECT key, bucket, (rn - 1) // 4 AS chain_pos, (rn - 1) % 4 AS slot FROM (SELECT key, bucket, row_number() OVER (PARTITION BY bucket ORDER BY key) AS rn FROM "


@query(f"WITH {_RMI} {_LAYOUT} hit)")
def table_chained_model_layout(spark, d):
    p = predicted(spark, d).select("key", F.col("bucket").alias("b"))
    return tables.chained(p, F.col("b"), 4).drop("b")


@query(f"WITH {_RANK} {_LAYOUT} (SELECT key, rank % {BUCKETS} AS bucket FROM y))")
def table_chained_rank_layout(spark, d):
    return tables.chained(M.rank_model(prices(spark, d)), F.col("rank") % BUCKETS, 4).drop("rank")


def _occupancy_sql(source: str) -> str:
    return f"SELECT n AS keys, count(*) AS buckets FROM (SELECT coalesce(c.n, 0) AS n FROM (SELECT unnest(range(0, {BUCKETS})) AS bucket) b LEFT JOIN (SELECT bucket, count(*) AS n FROM ({source}) GROUP BY 1) c USING (bucket)) GROUP BY 1"


@query(_occupancy_sql(f"SELECT {_B} AS bucket FROM orders"))
def stats_chain_occupancy_hash(spark, d):
    return stats.occupancy(r(spark, d).select(bucket().alias("bucket")), BUCKETS)


@query(f"WITH {_RMI} {_occupancy_sql('SELECT bucket FROM hit')}")
def stats_chain_occupancy_model(spark, d):
    return stats.occupancy(predicted(spark, d), BUCKETS)


@query(f"WITH {_RANK} {_occupancy_sql(f'SELECT rank % {BUCKETS} AS bucket FROM y')}")
def stats_chain_occupancy_rank(spark, d):
    return stats.occupancy(M.rank_model(prices(spark, d)).select((F.col("rank") % BUCKETS).alias("bucket")), BUCKETS)


_PROBE = f"{_R}, h AS (SELECT key, {H.murmur32_sql('key')} % (SELECT (count(*) * 4) // 3 FROM r) AS ideal FROM r), i AS (SELECT key, ideal, row_number() OVER (ORDER BY ideal, key) - 1 AS i FROM h), a AS (SELECT key, ideal, i + max(ideal - i) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS actual FROM i)"


def probed(spark, d) -> DataFrame:
    keys = r(spark, d).select("key")
    return tables.linear_probe(keys, H.mod(H.murmur32(F.col("key")), keys.count() * 4 // 3))


@query(f"WITH {_PROBE} SELECT key, ideal, actual FROM a")
def table_linear_probe_layout(spark, d):
    return probed(spark, d).select("key", "ideal", "actual")


def _slots_sql(ideal: str, size: int = 1) -> str:
    """A layout by linear probing of ``h`` (key, ideal), after other common table expressions."""
    return f"{ideal}, i AS (SELECT key, ideal, row_number() OVER (ORDER BY ideal, key) - 1 AS i FROM h), a AS (SELECT key, ideal, i + max(ideal * {size} - i) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS actual FROM i)"


_MODEL_SLOTS = _RMI + ", h AS (SELECT key, CAST(least(greatest(floor(cdf * ((n * 4) // 3)), 0), (n * 4) // 3 - 1) AS BIGINT) AS ideal FROM hit, b)"


def model_slots(spark, d) -> DataFrame:
    """Prices spread by a model over a third more slots than there are keys."""
    rmi = M.fit_rmi(prices(spark, d), LEAVES)
    placed = rmi.predict(rmi.placed.select("key"), rmi.n * 4 // 3).select("key", F.col("bucket").alias("slot"))
    return tables.linear_probe(placed, F.col("slot")).select("key", "ideal", "actual", "run")


@query(f"WITH {_slots_sql(_MODEL_SLOTS)} SELECT key, ideal, actual FROM a")
def table_probe_model_layout(spark, d):
    return model_slots(spark, d).select("key", "ideal", "actual")


@query(f"WITH {_slots_sql(_RANK + ', h AS (SELECT key, (rank * 7) % ((n * 4) // 3) AS ideal FROM y, b)')} SELECT key, ideal, actual FROM a")
def table_probe_rank_layout(spark, d):
    keys = M.rank_model(prices(spark, d))
    return tables.linear_probe(keys, (F.col("rank") * 7) % (keys.count() * 4 // 3)).select("key", "ideal", "actual")


@query(f"WITH {_slots_sql(_R + ', h AS (SELECT key, ' + H.murmur32_sql('key') + ' % (SELECT (count(*) * 4) // 12 FROM r) AS ideal FROM r)', 4)} SELECT key, ideal, actual, actual // 4 AS bucket FROM a")
def table_probe_buckets_layout(spark, d):
    """Linear probing over buckets of four."""
    keys = r(spark, d).select("key")
    layout = tables.linear_probe(keys, H.mod(H.murmur32(F.col("key")), keys.count() * 4 // 12), 4)
    return layout.select("key", "ideal", "actual", F.floor(F.col("actual") / 4).alias("bucket"))


@query(f"WITH {_slots_sql(_MODEL_SLOTS)}, o AS (SELECT actual - row_number() OVER (ORDER BY actual) AS run FROM a) SELECT keys, count(*) AS runs FROM (SELECT count(*) AS keys FROM o GROUP BY run) GROUP BY 1")
def stats_gapped_runs(spark, d):
    return stats.run_lengths(model_slots(spark, d))


@query("SELECT key, first, rows FROM (SELECT l_partkey AS key, min(rk) - 1 AS first, count(*) AS rows FROM (SELECT l_partkey, rank() OVER (ORDER BY l_partkey) AS rk FROM lineitem) GROUP BY 1)")
def window_first_duplicate(spark, d):
    return ordering.first_places(table(spark, d, "lineitem").select(F.col("l_partkey").alias("key")))


@query(f"WITH {_PROBE} SELECT actual - ideal AS distance, count(*) AS keys FROM a GROUP BY 1")
def stats_probe_distance(spark, d):
    return stats.displacement(probed(spark, d))


@query(f"WITH {_PROBE}, o AS (SELECT actual, actual - row_number() OVER (ORDER BY actual) AS island FROM a) SELECT distance, count(*) AS slots FROM (SELECT max(actual) OVER (PARTITION BY island) - actual + 1 AS distance FROM o) GROUP BY 1")
def stats_distance_to_empty(spark, d):
    return stats.distance_to_empty(probed(spark, d))


_B2 = H.murmur32_sql("xor(" + _HASH + ", 408957)")


def candidates(spark, d) -> DataFrame:
    h = H.murmur32(F.col("key"))
    return tables.cuckoo_candidates(r(spark, d).select("key"), H.mod(h, BUCKETS), H.mod(h.bitwiseXOR(F.lit(408957)), BUCKETS), BUCKETS)


_CANDIDATES = f"c AS (SELECT key, b1, CASE WHEN b1 = b2 THEN (b2 + 1) % {BUCKETS} ELSE b2 END AS b2 FROM (SELECT o_orderkey AS key, {_B} AS b1, xor({_HASH}, 408957) % {BUCKETS} AS b2 FROM orders))"


@query(f"WITH {_CANDIDATES} SELECT key, b1, b2 FROM c")
def table_cuckoo_candidates(spark, d):
    return candidates(spark, d)


@query(f"WITH {_CANDIDATES} SELECT avg(CASE WHEN rn <= 8 THEN 1e0 ELSE 0e0 END) AS ratio FROM (SELECT row_number() OVER (PARTITION BY b1 ORDER BY key) AS rn FROM c)")
def stats_cuckoo_primary_ratio(spark, d):
    return stats.primary_ratio(tables.cuckoo_primary(candidates(spark, d), 8))


@query(f"WITH {_RMI} SELECT key, bucket AS b1, CASE WHEN bucket = b2 THEN (b2 + 1) % {BUCKETS} ELSE b2 END AS b2 FROM (SELECT key, bucket, {H.murmur32_sql('key')} % {BUCKETS} AS b2 FROM hit)")
def table_cuckoo_model_candidates(spark, d):
    """The first bucket from a model, the second from a hash alone."""
    p = predicted(spark, d).select("key", "bucket")
    return tables.cuckoo_candidates(p, F.col("bucket"), H.mod(H.murmur32(F.col("key")), BUCKETS), BUCKETS).drop("bucket")


@query(f"WITH {_CANDIDATES} SELECT avg(CASE WHEN rn <= 8 THEN 1e0 ELSE 0e0 END) AS ratio FROM (SELECT key, row_number() OVER (PARTITION BY b1 ORDER BY key) AS rn FROM c) WHERE key IN (SELECT l_orderkey * 2 FROM lineitem)")
def stats_cuckoo_primary_ratio_of_keys(spark, d):
    return stats.primary_ratio_of(tables.cuckoo_primary(candidates(spark, d), 8), s_missing(spark, d))


def cuckoo_table(spark, d) -> DataFrame:
    h = H.murmur32(F.col("key"))
    keys = r(spark, d).select("key")
    n = tables.directory_size(keys.count(), 4, 34)
    return tables.cuckoo_layout(tables.cuckoo_candidates(keys, H.mod(h, n), H.mod(H.murmur32(h.bitwiseXOR(F.lit(408957))), n), n), 4)


@query()
def table_cuckoo_layout(spark, d):
    return cuckoo_table(spark, d)


@query("SELECT count(*) AS keys, count(*) AS placed, 1 AS fits FROM orders")
def table_cuckoo_invariants(spark, d):
    """Every key in one of its two buckets, none of which holds more than four."""
    t = cuckoo_table(spark, d)
    per = t.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.col("bucket").isin(F.col("b1"), F.col("b2")).cast("long")).alias("ok"))
    return per.agg(F.sum("n").alias("keys"), F.sum("ok").alias("placed"), (F.max("n") <= 4).cast("int").alias("fits"))


@query(f"WITH {_RMI}, o AS (SELECT cdf, lead(cdf) OVER (ORDER BY cdf) AS nxt FROM hit) SELECT CAST(ceil((nxt - cdf) * n * 50 - 0.1e0) * 2 AS BIGINT) AS bin, count(*) AS gaps FROM o, b WHERE nxt IS NOT NULL GROUP BY 1")
def stats_gap_histogram(spark, d):
    rmi = M.fit_rmi(prices(spark, d), LEAVES)
    return stats.gaps(rmi.predict(rmi.placed, BUCKETS), rmi.n)


@query(f"WITH {_RMI} SELECT max(n) AS most FROM (SELECT count(*) AS n FROM hit GROUP BY bucket)")
def stats_max_collision(spark, d):
    return stats.max_collision(predicted(spark, d))


@query(f"WITH c AS (SELECT {_B} AS bucket, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT CAST({BUCKETS} * 72 + sum(greatest(ceil(n / 4e0) - 1, 0)) * 72 AS BIGINT) AS table_bytes, sum(n) AS n FROM c) SELECT table_bytes, table_bytes * 8e0 / CAST(n AS DOUBLE) AS bits_per_key FROM t")
def stats_table_bytes(spark, d):
    return tables.chained_bytes(r(spark, d).select(bucket().alias("bucket")), BUCKETS, 4)


@query(f"WITH {_R}, n AS (SELECT count(*) AS n FROM r) SELECT kind, table_bytes, table_bytes * 8e0 / n AS bits_per_key FROM n, LATERAL (VALUES ('cuckoo', CAST(((n * 134 + 100) // 400) * 4 * 16 AS BIGINT)), ('probe', CAST(((n * 134 + 100) // 100) * 16 AS BIGINT)), ('probe model', CAST(((n * 134 + 100) // 100) * 16 + 1616 AS BIGINT)), ('rank', CAST(ceil(n * 8.375e0) AS BIGINT))) v(kind, table_bytes)")
def stats_all_table_bytes(spark, d):
    keys = r(spark, d).select("key")
    n = keys.count()
    kinds = {"cuckoo": tables.open_bytes(keys, tables.directory_size(n, 4, 34), 4), "probe": tables.open_bytes(keys, tables.directory_size(n, 1, 34), 1), "probe model": tables.open_bytes(keys, tables.directory_size(n, 1, 34), 1, model_bytes=tables.model_bytes(LEAVES)), "rank": tables.rank_bytes(keys)}
    out = None
    for kind, sized in kinds.items():
        row = sized.select(F.lit(kind).alias("kind"), "table_bytes", "bits_per_key")
        out = row if out is None else out.unionByName(row)
    return out


# Grids: a table for each choice of parameters.

@query(grids.chained_sql("orders", "o_orderkey", (0, 34, 100, 300, 10050)))
def sweep_chained(spark, d):
    return grids.chained(r(spark, d).select("key"), (0, 34, 100, 300, 10050))


@query(grids.probe_sql("orders", "o_orderkey", (34, 122, 300)))
def sweep_probe(spark, d):
    return grids.probe(r(spark, d).select("key"), (34, 122, 300))


@query(grids.matrix_sql())
def sweep_joins(spark, d):
    return grids.matrix(spark, {"orders": (r(spark, d), s(spark, d)), "misses": (r(spark, d), s_missing(spark, d))}, ("auto", "css_tree", "chained", "linear_probe", "miss"))


# Sorting

@query("SELECT l_orderkey AS key, l_linenumber AS line FROM lineitem ORDER BY 1, 2")
def sort_full(spark, d):
    return sorting.sort(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line")), "key", "line")


@query(f"WITH {_RMI} SELECT bucket // 100 AS part, count(*) AS rows FROM hit GROUP BY 1")
def sort_cdf_partition_histogram(spark, d):
    return sorting.cdf_histogram(predicted(spark, d), F.floor(F.col("bucket") / 100))


@query("SELECT o_orderkey AS key FROM orders UNION ALL SELECT l_orderkey FROM lineitem")
def sort_merge_two(spark, d):
    return sorting.merge(r(spark, d).select("key"), s(spark, d))


@query("SELECT l_partkey AS key, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(*) >= 40")
def sort_heavy_hitters(spark, d):
    return sorting.heavy_hitters(table(spark, d, "lineitem").select(F.col("l_partkey").alias("key")), 40)


@query("SELECT DISTINCT l_partkey AS key FROM lineitem")
def sort_dedupe(spark, d):
    return sorting.dedupe(table(spark, d, "lineitem").select(F.col("l_partkey").alias("key")))


@query("SELECT l_partkey AS key FROM lineitem")
def sort_repeated_keys(spark, d):
    return sorting.expanded(sorting.compressed(table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"))))


# Set operations

@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def set_with_holes(spark, d):
    return sets.with_holes(r(spark, d).select("key"), table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("key")))


@query("SELECT c_custkey AS key FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(spark, d):
    return sets.intersect(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), table(spark, d, "orders").select(F.col("o_custkey").alias("key")))


# Generators

def _n(spark, d) -> int:
    return table(spark, d, "orders").count()


_IDS = "i AS (SELECT unnest(range(0, (SELECT count(*) FROM orders))) AS id)"


def _unit_sql(i: str, seed: int, stream: int = 0) -> str:
    return f"(({H.murmur32_sql(f'xor({i} + {stream * 7919 + 1}, {G.mixed(seed)})')}) + 0.5e0) / 4294967296e0"


@query(f"WITH {_IDS} SELECT id * 10 + 20000 AS key FROM i")
def gen_sequential(spark, d):
    return G.sequential(spark, _n(spark, d))


@query(f"WITH {_IDS}, j AS (SELECT id, floor(ln({_unit_sql('id', 0)}) / {math.log(0.1)!r}) + 1 AS jump FROM i) SELECT CAST(sum(jump) OVER (ORDER BY id) * 10 AS BIGINT) AS key FROM j")
def gen_gapped(spark, d):
    return G.gapped(spark, _n(spark, d))


_UNIFORM = f"u AS (SELECT DISTINCT CAST(floor({_unit_sql('id', 0)} * 1099511627776 + {_unit_sql('id', 0, 3)} * 256) AS BIGINT) AS key FROM i)"


@query(f"WITH {_IDS}, {_UNIFORM} SELECT key FROM u")
def gen_uniform(spark, d):
    return G.uniform(spark, _n(spark, d))


@query(f"WITH {_IDS}, {_UNIFORM}, e AS (SELECT key, (row_number() OVER (ORDER BY key) - 1) * (1099511627776e0 / (SELECT count(*) FROM i)) AS even FROM u) SELECT DISTINCT CAST(greatest(floor(even + (key - even) * 2e0), 0) AS BIGINT) AS key FROM e")
def gen_variance_4(spark, d):
    return G.variance(spark, _n(spark, d), G.VARIANCES["variance_4"])


_Z = "floor(sqrt(-2e0 * ln({a})) * cos(6.283185307179586 * {b}) * 1e9) / 1e9"
_NORMAL = _Z.format(a=_unit_sql("id", 0, 1), b=_unit_sql("id", 0, 2))


@query(f"WITH {_IDS}, z AS (SELECT {_NORMAL} AS z FROM i) SELECT DISTINCT CAST(floor((least(greatest(z * 20 + 100, 40e0), 160e0) - 40) * 1099511627776e0) AS BIGINT) AS key FROM z")
def gen_normal(spark, d):
    return G.normal(spark, _n(spark, d))


@query(f"WITH {_IDS} SELECT id + 1 AS key, CAST(0 AS BIGINT) AS payload FROM i")
def gen_pk(spark, d):
    return G.primary_keys(spark, _n(spark, d))


@query(f"WITH {_IDS} SELECT id % 100 + 1 AS key, id AS payload FROM i")
def gen_fk(spark, d):
    return G.foreign_keys(spark, _n(spark, d), 100)


@query(f"WITH {_IDS}, h AS (SELECT unnest(range(1, CAST(floor((SELECT count(*) FROM orders) * 1.1e0) AS BIGINT) + 1)) AS key) SELECT key FROM h ORDER BY {H.murmur32_sql('xor(key, 0)')}, key LIMIT (SELECT count(*) FROM orders)")
def gen_holes(spark, d):
    return G.holes(spark, _n(spark, d))


@query(f"WITH {_IDS}, z AS (SELECT id, {_NORMAL} AS z FROM i) SELECT CAST(floor(abs(exp(z * 1e0)) * ((SELECT count(*) FROM orders) / 10e0)) AS BIGINT) AS key, id AS payload FROM z")
def gen_lognormal(spark, d):
    n = _n(spark, d)
    return G.skewed(spark, n, "lognormal", n / 10)


@query(f"WITH {_IDS}, z AS (SELECT id, {_NORMAL} AS z FROM i) SELECT CAST(floor(abs(z) * 100e0) AS BIGINT) AS key, id AS payload FROM z")
def gen_normal_fk(spark, d):
    return G.skewed(spark, _n(spark, d), "normal", 100.0)


@query(f"WITH {_IDS} SELECT CAST(floor(abs(-ln({_unit_sql('id', 0)})) * 100e0) AS BIGINT) AS key, id AS payload FROM i")
def gen_exponential_fk(spark, d):
    return G.skewed(spark, _n(spark, d), "exponential", 100.0)


@query(f"WITH {_IDS} SELECT {H.murmur32_sql(f'xor(id, {G.mixed(0)})')} AS key FROM i")
def gen_unique32(spark, d):
    return G.unique32(spark, _n(spark, d))


for _name, _factor in (("variance_2", "1.414e0"), ("variance_half", "(1 / 1.414e0)"), ("variance_quarter", "0.5e0")):
    query(f"WITH {_IDS}, {_UNIFORM}, e AS (SELECT key, (row_number() OVER (ORDER BY key) - 1) * (1099511627776e0 / (SELECT count(*) FROM i)) AS even FROM u) SELECT DISTINCT CAST(greatest(floor(even + (key - even) * {_factor}), 0) AS BIGINT) AS key FROM e", f"gen_{_name}")(lambda spark, d, x=_name: G.variance(spark, _n(spark, d), G.VARIANCES[x]))


@query("SELECT CASE WHEN epoch_us(ts) = m THEN m - 1 ELSE epoch_us(ts) END AS key, CASE WHEN epoch_us(ts) = m THEN m - 1 ELSE epoch_us(ts) END AS payload FROM events, (SELECT max(epoch_us(ts)) AS m FROM events)")
def gen_de_sentinel(spark, d):
    """Times as their own payloads, the greatest taken for a sentinel."""
    times = table(spark, d, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("key"))
    return G.self_payload(G.de_sentinel(times, times.agg(F.max("key")).first()[0]))


@query(f"WITH {_IDS} SELECT CAST(floor({_unit_sql('id', 0)} * 500) AS BIGINT) AS key, id AS payload FROM i")
def gen_uniform_fk(spark, d):
    return G.skewed(spark, _n(spark, d), "uniform", 500)


@query(f"WITH {_R} SELECT key, key - 5 AS payload FROM r")
def gen_payload(spark, d):
    return G.with_payload(r(spark, d))


@query("SELECT epoch_us(ts) - 1073741824 AS key FROM events WHERE epoch_us(ts) > 0 AND log2(epoch_us(ts)) BETWEEN 50 AND 51")
def gen_log2_band(spark, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return G.band(table(spark, d, "events").select(micros.alias("key")), 50, 51, 1 << 30)


@query(f"WITH {_R}, k AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS place FROM r), p AS (SELECT probe_id, k.key, {_unit_sql('probe_id', 3, 5)} < 0.8e0 AS hits FROM (SELECT o_orderkey AS probe_id, CAST(floor({_unit_sql('o_orderkey', 3)} * (SELECT count(*) FROM orders)) AS BIGINT) AS place FROM orders) JOIN k USING (place)), m AS (SELECT probe_id, hits, CASE WHEN hits THEN key ELSE key + 1 + CAST(floor({_unit_sql('probe_id', 3, 6)} * 331777) AS BIGINT) END AS near FROM p) SELECT probe_id, CASE WHEN hits OR near NOT IN (SELECT key FROM r) THEN near ELSE (SELECT min(key) FROM r) - 1 - probe_id END AS key FROM m")
def probe_uniform_mix(spark, d):
    return G.probes(r(spark, d), _n(spark, d), 0.8, seed=3)


@query(f"WITH {_R}, k AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS place FROM r), p AS (SELECT probe_id, k.key, {_unit_sql('probe_id', 4, 5)} < 0.9e0 AS hits FROM (SELECT o_orderkey AS probe_id, CAST(floor(least(-ln({_unit_sql('o_orderkey', 4)}) / 10, 1 - 1e-12) * (SELECT count(*) FROM orders)) AS BIGINT) AS place FROM orders) JOIN k USING (place)), m AS (SELECT probe_id, hits, CASE WHEN hits THEN key ELSE key + 1 + CAST(floor({_unit_sql('probe_id', 4, 6)} * 331777) AS BIGINT) END AS near FROM p) SELECT probe_id, CASE WHEN hits OR near NOT IN (SELECT key FROM r) THEN near ELSE (SELECT min(key) FROM r) - 1 - probe_id END AS key FROM m")
def probe_exponential(spark, d):
    return G.probes(r(spark, d), _n(spark, d), 0.9, "exponential_sorted", 4)


@query(f"WITH {_R}, {_IDS}, k AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS place FROM r), q AS (SELECT id AS query_id, CAST(floor({_unit_sql('id', 0)} * (SELECT count(*) FROM r)) AS BIGINT) AS place, CAST(1 AS BIGINT) << (id % 11) AS step FROM i) SELECT query_id, a.key AS lo, b.key AS hi FROM q JOIN k a ON a.place = q.place JOIN k b ON b.place = least(q.place + step, (SELECT count(*) FROM r) - 1)")
def probe_ranges(spark, d):
    return G.range_queries(r(spark, d), _n(spark, d))


# Reports: each supplier and part stands for a benchmark, a line for a run of it.

_RUNS = "r AS (SELECT 'Probe' || (l_suppkey % 50) || '<x, ' || (l_partkey % 5) || '>' AS name, l_extendedprice AS cpu_time, l_quantity AS bits, l_returnflag || ':' || l_linestatus AS label, CAST(1000000 + l_orderkey AS DOUBLE) AS data_elem_count FROM lineitem)"


def runs(spark, d) -> DataFrame:
    name = F.concat(F.lit("Probe"), F.col("l_suppkey") % 50, F.lit("<x, "), F.col("l_partkey") % 5, F.lit(">"))
    return table(spark, d, "lineitem").select(name.alias("name"), F.col("l_extendedprice").alias("cpu_time"), F.col("l_quantity").alias("bits"), F.concat_ws(":", "l_returnflag", "l_linestatus").alias("label"), (F.col("l_orderkey") + 1000000).cast("double").alias("data_elem_count"))


@query(f"WITH {_RUNS} SELECT name, cpu_time, bits, label, data_elem_count FROM r QUALIFY row_number() OVER (PARTITION BY name ORDER BY cpu_time, bits, label, data_elem_count) = 1")
def report_best_per_name(spark, d):
    return reports.best_per_name(runs(spark, d))


@query(f"WITH {_RUNS} SELECT DISTINCT name FROM r WHERE name NOT IN (SELECT name FROM r WHERE bits > 49) ORDER BY name LIMIT 1000")
def report_new_names(spark, d):
    return reports.new_names(runs(spark, d), runs(spark, d).where("bits > 49"))


@query(f"WITH {_RUNS} SELECT name, cpu_time, data_elem_count, cpu_time / data_elem_count AS ns_per_key, 1e9 / (cpu_time / data_elem_count) AS keys_per_second, (1000 + data_elem_count) / (cpu_time * 1000e0) AS mtuples FROM r")
def report_throughput(spark, d):
    out = reports.derived(runs(spark, d)).withColumn("mtuples", reports.throughput(F.lit(1000), F.col("data_elem_count"), F.col("cpu_time")))
    return out.select("name", "cpu_time", "data_elem_count", "ns_per_key", "keys_per_second", "mtuples")


@query(f"WITH {_RUNS}, b AS (SELECT bits, min(cpu_time) AS cpu_time FROM r GROUP BY 1), f AS (SELECT *, min(cpu_time) OVER (ORDER BY bits ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b) SELECT r.name, r.bits, r.cpu_time FROM r JOIN f ON r.bits = f.bits AND r.cpu_time = f.cpu_time WHERE before IS NULL OR f.cpu_time < before")
def report_pareto(spark, d):
    return reports.pareto(runs(spark, d), "bits", "cpu_time").select("name", "bits", "cpu_time")


@query(f"WITH {_RUNS} SELECT name, split_part(label, ':', 1) AS method, split_part(label, ':', 2) AS dataset, '-' AS probe_distribution, regexp_extract(name, ',\\s*(\\d+)>', 1) AS range_size, count(*) AS rows FROM r WHERE contains(lower(name), 'probe') AND data_elem_count > 1001000 GROUP BY ALL")
def report_labels(spark, d):
    out = reports.labels(reports.of_kind(runs(spark, d), "probe", 1001000))
    return out.groupBy("name", "method", "dataset", "probe_distribution", "range_size").agg(F.count("*").alias("rows"))


@query(f"WITH {_RUNS} SELECT label, round(CAST(sum(CAST(cpu_time AS DECIMAL(18,2))) AS DOUBLE) / sum(data_elem_count), 9) AS ns FROM r GROUP BY 1")
def report_latency(spark, d):
    # Sums of cents and of whole numbers, so their order doesn't matter.
    exact = runs(spark, d).withColumn("cpu_time", F.col("cpu_time").cast("decimal(18,2)"))
    out = reports.latency(exact, "label", "cpu_time", "data_elem_count")
    return out.select("label", F.round("ns", 9).alias("ns"))


@query(f"WITH {_RUNS} SELECT name, count(*) AS rows FROM r WHERE NOT starts_with(label, 'A') GROUP BY 1")
def report_visible(spark, d):
    return reports.visible(reports.labels(runs(spark, d)), "A").groupBy("name").agg(F.count("*").alias("rows"))


@query("SELECT o_orderkey AS run, 'RMI:' || CASE o_orderkey % 12 WHEN 0 THEN 'seq' WHEN 1 THEN 'gap_10' WHEN 2 THEN 'uniform' WHEN 3 THEN 'normal' WHEN 4 THEN 'wiki' WHEN 5 THEN 'osm' WHEN 6 THEN 'fb' WHEN 7 THEN 'Variance_2' WHEN 8 THEN 'Variance_4' WHEN 9 THEN 'Variance_half' WHEN 10 THEN 'Variance_quarter' ELSE '-' END || ':' || CASE o_orderkey % 3 WHEN 0 THEN 'uniform' WHEN 1 THEN 'exponential_sorted' ELSE 'exponential_random' END AS label FROM orders")
def report_named_labels(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("run"), reports.label(F.lit("RMI"), k % 12, k % 3).alias("label"))


# Streaming: events as probes of customers, in micro-batches.

@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS matches FROM events WHERE user_id IN (SELECT c_custkey FROM customer) GROUP BY 1")
def stream_probe_windows(spark, d):
    import uuid

    schema = table(spark, d, "events").schema
    # Only the events file is a source; the stream ends when it is read.
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    build = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    name = "probe_" + uuid.uuid4().hex
    run = stream_probe.hits_by_window(stream, build, "ts", "1 day", "1 day").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "matches")
