"""Compare a Spark result with a DuckDB statement: columns by name, rows as a multiset."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[:-len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v) if abs(v) < 2 ** 53 else v
    return str(v) if v is not None and not isinstance(v, (str, bool)) else v


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> str | None:
    """None when equal, else a description."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    got = rows_of(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    if want != got:
        return (f"{sum(got.values())} rows instead of {sum(want.values())}; "
                f"extra {list((got - want).items())[:3]}; missing {list((want - got).items())[:3]}")
    return None
