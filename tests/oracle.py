"""Compare a query with its SQL twin."""

import glob
import math
import os

import duckdb


def connect(sf: str):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9) + 0.0)
    return str(x)


def _sorted(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def same(spark, sf: str, queries: dict, sql: dict, name: str) -> None:
    df = queries[name](spark, sf)
    cur = connect(sf).execute(sql[name])
    rows = cur.fetchall()
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert _sorted([tuple(r) for r in df.collect()], df.columns) == _sorted(rows, cols)
