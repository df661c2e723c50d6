import os

import pytest
from pyspark.sql import functions as F

from sheaf.operators.state import granted
from sheaf.streaming import flows
from tests.util import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def batch(spark):
    return spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def test_a_ledger_fires_once(spark, tmp_path):
    stream = flows.first_of(flows.read_events(spark, DATA), ["user_id", "event_type"])
    got = flows.run_to_end(stream.select("user_id", "event_type"), "ledger", str(tmp_path))
    assert sorted(got.collect()) == sorted(batch(spark).select("user_id", "event_type").distinct().collect())


def test_hourly_counts_equal_the_batch(spark, tmp_path):
    got = flows.run_to_end(flows.hourly_counts(flows.read_events(spark, DATA)), "hourly", str(tmp_path), "complete")
    want = batch(spark).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    assert sorted(got.collect()) == sorted(want.collect())


def test_the_limiter_equals_its_closed_form(spark, tmp_path):
    got = flows.run_to_end(flows.limited(flows.read_events(spark, DATA), 3600.0), "limited", str(tmp_path))
    want = granted(batch(spark).withColumn("s", F.unix_micros("ts") / 1e6), "user_id", F.col("s"), ["ts", "event_id"], 3600.0).select("event_id", "granted")
    a, b = dict(got.collect()), dict(want.collect())
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-3 for k in a)
