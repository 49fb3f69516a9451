"""Runs a query on Spark and its SQL on DuckDB and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.01"


def connect(data: str = DATA) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT or v is pd.NA:
            return (0, "")
        if isinstance(v, bool):
            return (1, str(v))
        if isinstance(v, (int, float)):
            return (2, round(float(v), 6) + 0.0)
        return (3, str(v))

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def differences(spark_df, sql: str, con: duckdb.DuckDBPyConnection) -> list:
    got, want = spark_df.toPandas(), con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return [sorted(got.columns), sorted(want.columns)]
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return [len(a), len(b), [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]]
    return [(x, y) for x, y in zip(a, b, strict=True) if x != y and not all(p == q or (p[0] == q[0] == 2 and abs(p[1] - q[1]) <= 1e-6 * max(1, abs(q[1]))) for p, q in zip(x, y, strict=True))][:3]
