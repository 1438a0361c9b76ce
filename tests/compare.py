"""Spark rows against DuckDB rows of the same tables."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    return x


def spark_rows(df):
    order = sorted(df.columns)
    def value(v):
        return plain(v.asDict() if hasattr(v, "asDict") else [i.asDict() if hasattr(i, "asDict") else i for i in v] if isinstance(v, list) else v)
    return order, Counter(tuple(value(r[c]) for c in order) for r in df.collect())


def duck_rows(sql, sf_dir, replaced=None):
    con = duckdb.connect()
    for t in TABLES:
        path = (replaced or {}).get(t, f"{sf_dir}/{t}.parquet")
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    got = con.sql(sql)
    cols = [d[0] for d in got.description]
    order = sorted(cols)
    at = [cols.index(c) for c in order]
    return order, Counter(tuple(plain(r[i]) for i in at) for r in got.fetchall())


def differences(df, sql, sf_dir):
    """What differs, in words; empty when nothing does."""
    (a, x), (b, y) = spark_rows(df), duck_rows(sql, sf_dir)
    if a != b:
        return f"columns {a} and {b}"
    more, less = x - y, y - x
    return f"{sum(x.values())} and {sum(y.values())} rows; only Spark {list(more)[:2]}; only SQL {list(less)[:2]}" if more or less else ""
