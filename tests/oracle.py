"""Compares a query with its SQL, as sets of rows with sorted columns."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*' if os.path.isdir(path) else ''}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 5)
    if hasattr(v, "as_tuple"):
        return round(float(v), 5)
    return v


def sql_rows(sql: str, sf_dir: str):
    c = connection(sf_dir)
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(x) for x in r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)
