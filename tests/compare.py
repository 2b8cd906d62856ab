"""Runs queries beside their SQL: same columns, same rows in any order."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(x):
    if isinstance(x, float):
        return round(x, 6)
    return float(round(x, 6)) if type(x).__name__ == "Decimal" else x


def same(spark, sf_dir: str, query, sql: str) -> str:
    """'' if equal, else what differs."""
    got = query(spark, sf_dir)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = db.execute(sql)
    names = [c[0] for c in want.description]
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    order = sorted(names)
    rows = sorted((tuple(_cell(r[c]) for c in order) for r in got.collect()), key=repr)
    other = sorted((tuple(_cell(dict(zip(names, r))[c]) for c in order) for r in want.fetchall()), key=repr)
    if rows != other:
        a, b = set(map(repr, rows)), set(map(repr, other))
        return f"{len(rows)} and {len(other)} rows; ours alone {sorted(a - b)[:3]}, SQL alone {sorted(b - a)[:3]}"
    return ""
