"""Rows of a DataFrame and of DuckDB SQL over the same tables, in a form that compares."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def connect(folder=SMALL):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(x):
    return None if isinstance(x, float) and math.isnan(x) else 0.0 if x == 0 and isinstance(x, float) else x


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)


def sql_rows(con, sql):
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    return cols, sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
