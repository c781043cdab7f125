"""Runs a query's SQL twin in DuckDB and compares the rows, whatever their order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def twin_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return names, [dict(zip(names, row, strict=True)) for row in found.fetchall()]


def plain(value):
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value.asDict().values())
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, int):
        return float(value)
    if type(value).__name__ == "Decimal":
        return float(value)
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return value


def rows_of(names, rows):
    order = sorted(names)
    return sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)


def assert_same(df, sql: str, sf_dir: str) -> None:
    names, want = twin_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got = rows_of(df.columns, [r.asDict() for r in df.collect()])
    want = rows_of(names, want)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6)), (a, b)
