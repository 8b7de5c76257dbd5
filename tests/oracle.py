"""Holds a query against its SQL in DuckDB."""

from pathlib import Path

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def value(x):
    return round(x, 6) if isinstance(x, float) else str(x) if isinstance(x, (dict, list)) else x


def same(df, c: duckdb.DuckDBPyConnection, sql: str, ordered: bool = False) -> None:
    got = df.collect()
    want = c.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    key = sorted(names)
    left = [[value(r[n]) for n in key] for r in got]
    right = [[value(r[names.index(n)]) for n in key] for r in want.fetchall()]
    assert (left == right) if ordered else sorted(left, key=str) == sorted(right, key=str)
