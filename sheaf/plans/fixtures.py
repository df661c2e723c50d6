"""Inline rows for shapes that the tables lack; the same text is read by Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def values(rows: list[tuple], *columns: str) -> str:
    """A SELECT over VALUES."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        if isinstance(v, int):
            return f"CAST({v} AS BIGINT)"
        return "'" + v.replace("'", "''") + "'"

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ") AS t(" + ", ".join(columns) + ")"


def inline(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)
