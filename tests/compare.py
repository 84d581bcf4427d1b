"""Runs a query in Spark and its SQL in DuckDB, over the same tables."""

import glob
import math
import os

import duckdb

TABLES = "/root/testdata/sf0.001"


def duck(tables=TABLES):
    c = duckdb.connect()
    for f in glob.glob(f"{tables}/*.parquet"):
        files = f"{f}/*.parquet" if os.path.isdir(f) else f
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{files}'")
    return c


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


def same(spark, query, sql, tables=TABLES):
    got = query(spark, tables)
    names = sorted(got.columns)
    expected = duck(tables).sql(sql)
    assert sorted(expected.columns) == names
    a = sorted(repr([plain(r[c]) for c in names]) for r in got.collect())
    at = [expected.columns.index(c) for c in names]
    b = sorted(repr([plain(r[i]) for i in at]) for r in expected.fetchall())
    assert len(a) == len(b)
    assert [(x, y) for x, y in zip(a, b, strict=True) if x != y][:3] == []
    return len(a)
