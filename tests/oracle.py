"""Run a query and its SQL side by side."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str(v)


def rows(frame, columns):
    return sorted(tuple(plain(x.item() if hasattr(x, "item") else x) for x in r) for r in frame[columns].itertuples(index=False))


def same(spark, sf, query, sql):
    got, want = query(spark, sf).toPandas(), connection(sf).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)
