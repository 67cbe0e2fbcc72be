"""Runs registered queries on Spark and their check SQL on DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if glob.glob(f"{folder}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{os.path.join(folder, t)}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v if v is None else str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(cols), sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, folder: str, fn, sql: str) -> tuple[bool, str, int]:
    df = fn(spark, folder)
    a_cols, a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(folder).execute(sql)
    b_cols, b = rows_of([x[0] for x in cur.description], cur.fetchall())
    if a_cols != b_cols:
        return False, f"columns {a_cols} / {b_cols}", len(a)
    if len(a) != len(b):
        return False, f"{len(a)} rows / {len(b)}", len(a)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}", len(a)
    return True, "", len(a)
