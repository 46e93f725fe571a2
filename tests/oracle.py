"""Runs a query's SQL in DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def expected(sql: str, sf_dir: str) -> list[dict]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return [dict(zip(names, row, strict=True)) for row in cur.fetchall()]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") and v.tzinfo else v


def rows(dicts) -> list[str]:
    return sorted(repr([(k, plain(d[k])) for k in sorted(d)]) for d in dicts)


def assert_matches(df, sql: str, sf_dir: str) -> int:
    got, want = rows(r.asDict() for r in df.collect()), rows(expected(sql, sf_dir))
    assert len(got) == len(want), f"{len(got)} rows, {len(want)} expected"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not bad, f"{len(bad)} of {len(got)} rows differ: {bad[0]}"
    return len(got)
