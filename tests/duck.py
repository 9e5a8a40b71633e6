"""Runs a query in Spark and its oracle in DuckDB and compares them as the driver does: columns by name, rows as a bag."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for name in TABLES:
        p = Path(sf) / f"{name}.parquet"
        con.sql(f"create view {name} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted([tuple(plain(r[k]) for k in order) for r in rows], key=str)


def compare(spark, sf, query, sql):
    df = query(spark, sf)
    found = connect(sf).execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = bag(df.columns, [tuple(r) for r in df.collect()]), bag(columns, found.fetchall())
    assert got == want, [x for x in zip(got, want, strict=False) if x[0] != x[1]][:3]
    return got
