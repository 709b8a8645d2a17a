"""Runs a query and its SQL over the same tables and compares rows without regard to order."""

from __future__ import annotations

import math
import os
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        source = f"{p}/*.parquet" if os.path.isdir(p) else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}" if v != int(v) else str(int(v))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if v is None or isinstance(v, str):
        return v
    return str(v)


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, query, sql: str) -> tuple[int, int, list, list]:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    con.execute(sql)
    names = [d[0] for d in con.description]
    want = rows_of(names, con.fetchall())
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    return sum(got.values()), sum(want.values()), list((got - want).items())[:3], list((want - got).items())[:3]
