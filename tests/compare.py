"""Compare a query with its SQL on the same tables, whatever the row order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{src}'")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return str([_cell(y) for y in x])
    return str(x)


def normal(cols: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def assert_same(df, sf_dir: str, sql: str) -> None:
    cols, rows = duck(sf_dir, sql)
    got = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(cols), (sorted(df.columns), sorted(cols))
    a, b = normal(df.columns, got), normal(cols, rows)
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b):
        assert x == y, (sorted(cols), x, y)
