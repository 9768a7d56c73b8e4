"""Runs a query's SQL with DuckDB over the same tables and compares rows without regard to order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str, tables=TABLES):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in tables:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v + 0:.6g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def same(df, con, sql: str) -> None:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    ours = [r.asDict() for r in df.collect()]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    a = sorted(tuple(plain(r[n]) for n in order) for r in ours)
    b = sorted(tuple(plain(r[names.index(n)]) for n in order) for r in theirs)
    assert len(a) == len(b)
    assert a == b
