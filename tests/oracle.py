"""Runs a query and its SQL over the same tables and compares the rows, whatever their order."""

import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
        return "NULL"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v).lower() if str(v) in ("True", "False") else str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(cell(v) for v in r) for r in df[names].itertuples(index=False))


def assert_same(spark, query, sql):
    got, expected = rows(query(spark, DATA).toPandas()), rows(connection().sql(sql).df())
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    assert got[1] == expected[1]
