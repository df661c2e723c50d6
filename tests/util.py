"""Differential harness: a query's rows in Spark against its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (not hasattr(v, "__len__") and pd.isna(v)):
            return "null"
        if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
            return str(bool(v))
        if not isinstance(v, str) and not hasattr(v, "__len__"):
            try:
                return f"{float(v):.9g}"
            except (TypeError, ValueError):
                pass
        return str(list(v)) if hasattr(v, "tolist") and not isinstance(v, str) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


def assert_same(spark_df, con, sql: str) -> None:
    a, b = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert canonical(a) == canonical(b)
