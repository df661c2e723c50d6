"""Parquet table sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """Rows re-delivered under one key count once: the values of the latest.

    One map-side combined aggregation; ties on the time (and null times, which
    lose against any time) are broken by the values themselves.
    """
    best = F.max_by(F.struct(*values), F.struct(F.col(at), *[F.col(v) for v in values if _orderable(df, v)]))
    return df.groupBy(*keys).agg(best.alias("_v")).select(*keys, "_v.*")


def _orderable(df: DataFrame, name: str) -> bool:
    return not df.schema[name].dataType.typeName().startswith(("map", "variant"))


def table_bytes(df: DataFrame) -> int:
    """Optimizer's size estimate of a plan, for checks before a broadcast."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def maybe_broadcast(df: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """Broadcast hint only where the estimated size is under the limit; beyond
    it the join is left to Catalyst, which shuffles."""
    return F.broadcast(df) if table_bytes(df) <= limit else df


def present(column: Column) -> Column:
    """Not null and not blank."""
    return column.isNotNull() & (F.trim(column) != "")


def spread(df: DataFrame, least: int = 1 << 20) -> DataFrame:
    """df over all cores if it is a plain scan of fewer files than half the cores.

    A file of one row group is one task however many cores there are; work on each
    row then runs on one of them. Larger inputs, whose scans make tasks enough,
    small ones, and anything but a scan stay as they are.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    if "Relation " not in text or any(w in text for w in ("Join", "Aggregate", "Window", "Repartition", "Limit", "MapIn", "Generate", "Union", "Sort")):
        return df
    size = table_bytes(df)
    split = int(str(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    if size < least or size >= cores * split:
        return df
    return df.repartition(cores) if 2 * max(len(df.inputFiles()), size // split) <= cores else df
