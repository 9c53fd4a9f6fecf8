"""Compares a query with its SQL in DuckDB, rows in any order."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if hasattr(v, "tolist") and getattr(v, "shape", ()):
        return repr(v.tolist())
    if v is None or v is pd.NA or v is pd.NaT:
        return "null"
    if "bool" in type(v).__name__:
        return str(bool(v))
    if isinstance(v, str):
        return v
    try:
        return "null" if v != v else repr(float(v))
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(map(tuple, df[cols].astype(object).map(plain).to_numpy().tolist()))


def assert_equal(spark_df, sql, folder):
    a, b = rows(spark_df.toPandas()), rows(connect(folder).sql(sql).df())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1]
