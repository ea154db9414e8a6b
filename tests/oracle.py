"""Runs catalog queries in Spark and their SQL in DuckDB on the same tables and compares rows, whatever their order."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return c


def plain(v):
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def difference(spark, con, run, sql, sf_dir):
    """None if equal, else what differs."""
    got = run(spark, sf_dir)
    names = sorted(got.columns)
    want = con.execute(sql)
    cols = [x[0] for x in want.description]
    if sorted(cols) != names:
        return f"columns {names} / {sorted(cols)}"
    a = sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=key)
    at = [cols.index(n) for n in names]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)
    if len(a) != len(b):
        return f"{len(a)} / {len(b)} rows, e.g. {sorted(set(a) ^ set(b), key=key)[:2]}"
    for x, y in zip(a, b, strict=True):
        if x != y:
            return f"{sum(p != q for p, q in zip(a, b, strict=True))} rows, e.g. {dict(zip(names, x, strict=True))} / {dict(zip(names, y, strict=True))}"
    return None
