"""Rows of a plan against rows of DuckDB SQL on the same tables."""

from __future__ import annotations

import datetime
from pathlib import Path


def plain(v):
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v) if isinstance(v, float) else str(v)


def database(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same_rows(df, con, sql: str) -> None:
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    expected = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert len(got) == len(expected)
    assert got == expected
