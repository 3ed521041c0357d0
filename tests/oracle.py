"""Runs registered queries next to their DuckDB SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v


def rows(columns: list[str], data) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


def difference(spark, run, sql: str, sf_dir: str) -> str:
    """'' if both give the same columns and rows."""
    df = run(spark, sf_dir)
    got = rows(df.columns, df.collect())
    rel = connect(sf_dir).sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {df.columns} and {rel.columns}"
    if got != want:
        a, b = [x for x in got if x not in set(want)], [x for x in want if x not in set(got)]
        return f"{len(got)} and {len(want)} rows; only here {len(a)} {a[:3]}; only there {len(b)} {b[:3]}"
    return ""
