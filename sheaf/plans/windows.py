"""Event-time windows in batch form (an extension) over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.sources.tables import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def ext_session_windows(spark: SparkSession, d: str) -> DataFrame:
    s = _events(spark, d).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_micros("w.start").alias("start"), "n")


def ext_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    h = _events(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return h.select(F.unix_micros("w.start").alias("start"), "event_type", "n")


QUERIES = {f.__name__: f for f in (ext_session_windows, ext_hourly_counts)}
SQL = {
    "ext_session_windows": "SELECT user_id, min(t) AS start, count(*) AS n FROM (SELECT user_id, t, sum(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY t, event_id) AS s FROM (SELECT user_id, event_id, epoch_us(ts) AS t, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 1800000000, true) AS new FROM events)) GROUP BY user_id, s",
    "ext_hourly_counts": "SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
