"""A query and its SQL over the same tables, compared as multisets of rows."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "-"
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.9g}"
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return str(x)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in found)


def duck(sf_dir, sql):
    con = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        con.sql(f"create view {p.stem} as select * from '{p / '*.parquet' if p.is_dir() else p}'")
    got = con.sql(sql)
    return rows(got.columns, got.fetchall())


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])
