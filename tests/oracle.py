"""Runs a registered query and its SQL on the same tables and compares rows."""

import functools
import glob
import math
import os

import duckdb


@functools.lru_cache
def database(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f + '/*.parquet' if os.path.isdir(f) else f}'")
    return con


def _plain(v):
    return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v


def compare(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=str)
    answer = database(sf_dir).execute(sql)
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(_plain(r[i]) for i in at) for r in answer.fetchall()), key=str)
