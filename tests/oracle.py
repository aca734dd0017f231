"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import decimal
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def same_rows(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = Counter(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
    have = Counter(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())
    assert have == want, (list((have - want))[:2], list((want - have))[:2])
