"""Spark query against its SQL counterpart, compared as the driver does: columns by name, rows in any order."""

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in values), key=lambda r: tuple((x is None, str(x)) for x in r))


def connection(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def compare(df, sql, sf):
    """Differences as text; empty if equal."""
    got_columns, got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = connection(sf).sql(sql)
    columns, want = rows(rel.columns, rel.fetchall())
    if got_columns != columns:
        return f"columns {got_columns} and {columns}"
    if got != want:
        a, b = [x for x in got if x not in want][:3], [x for x in want if x not in got][:3]
        return f"{len(got)} and {len(want)} rows; only ours {a}; only theirs {b}"
    return ""
