"""Runs a query and its SQL on the same tables and says where they differ."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _plain(v):
    import datetime
    import decimal

    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return (2, round(float(v), 9) + 0.0)
    if isinstance(v, (bytes, bytearray)):
        return (3, bytes(v).hex())
    if isinstance(v, (list, tuple)):
        return (4, tuple(map(_plain, v)))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return (5, str(v))
    return (6, str(v))


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def difference(df, sql: str, con) -> str:
    """Empty if both give the same columns and rows."""
    got_cols = df.columns
    got = rows(got_cols, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = rows(want_cols, cur.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} and {sorted(want_cols)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, as {bad[0]}" if bad else ""
