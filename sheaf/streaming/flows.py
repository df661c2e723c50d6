"""Streams: event-time windows, fire-once ledgers, limiter and cache state, incremental upserts.

Event-time windows and late data are an extension; each flow gives what its batch
form gives on the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, name: str = "events", files_each: int = 1) -> DataFrame:
    """The events of a folder as a stream; times without a zone become timestamps, as watermarks need."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).option("pathGlobFilter", f"{name}.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Events of each user's sessions, which end after a gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def hourly_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def first_of(events: DataFrame, keys: list[str], late: str = "3650 days") -> DataFrame:
    """The first arrival of each key within the watermark: a ledger that fires once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def limited(events: DataFrame, interval: float) -> DataFrame:
    """Each event with the second at which a limiter with a least interval grants it, per user."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for pdf in frames:
            pdf = pdf.sort_values(["ts", "event_id"])
            out = []
            for t in pdf["ts"].astype("int64") / 1e9:
                last = t if last is None else max(t, last + interval)
                out.append(last)
            yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "granted": out})
        state.update((last,))

    return events.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(step, "event_id long, granted double", "last double", "append", GroupStateTimeout.NoTimeout)


def upsert_batches(records: DataFrame, table_path: str, checkpoint: str):
    """Citation records into a table folder, a micro-batch at a time: each batch is folded into the
    store it finds, and written beside it before it takes its place."""
    from sheaf.operators.shelf import fold_shelf

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path, before = f"{table_path}/v{number}", f"{table_path}/v{number - 1}"
        new = batch
        if number:
            new = spark.read.parquet(f"{before}/log").unionByName(batch, allowMissingColumns=True)
        new.write.mode("overwrite").parquet(f"{path}/log")
        fold_shelf(spark.read.parquet(f"{path}/log")).write.mode("overwrite").parquet(f"{path}/store")

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a bounded stream to its end into a memory table; for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
