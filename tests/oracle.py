"""Spark results against DuckDB's on the same Parquet tables."""

import datetime
import decimal
import numbers
from pathlib import Path

import duckdb

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(x):
    if x is None or x != x:
        return "-"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, numbers.Number | decimal.Decimal):
        return f"{float(x):.6g}" if isinstance(x, float) and not float(x).is_integer() else str(int(x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(one(r[i]) for i in order) for r in found)


def same(df, sql, sf=SF):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = c.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
