"""Compare registered queries with their SQL on DuckDB: names, row count, values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)


def rows_of(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, sorted(tuple(plain(v) for v in row) for row in zip(*columns))


def differences(df, con, sql):
    """Empty when equal, else a short description."""
    names, got = rows_of(df.toArrow())
    expected = con.execute(sql)
    expected = expected.to_arrow_table() if hasattr(expected, "to_arrow_table") else expected.arrow()
    if hasattr(expected, "read_all"):
        expected = expected.read_all()
    other, want = rows_of(expected)
    if names != other:
        return f"columns {names} != {other}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; {got[:2]} {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, first {bad[:3]}"
    return ""
