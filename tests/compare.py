"""Comparison of a DataFrame with the rows of DuckDB SQL over the same tables."""

from __future__ import annotations

import datetime
import math
import os
from collections import Counter

import duckdb


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def bag(rows) -> Counter:
    return Counter(tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in map(plain, r)) for r in rows)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def assert_same(df, sql: str, sf_dir: str) -> None:
    con = connect(sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(names) == sorted(df.columns)
    got = [tuple(r[c] for c in names) for r in df.collect()]
    a, b = bag(got), bag(want)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
