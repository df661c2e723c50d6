"""Threads as adjacency rows: trees by recursive SQL over a sortable path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEEPEST = 6
DIGITS = 20  # more than any id of 64 bits has


def thread_tree(rows: DataFrame, thread: str, node: str, parent: str, deepest: int = DEEPEST) -> DataFrame:
    """(thread, node, depth, path): nodes reachable from roots (null parents), depth below ``deepest``.

    Level by level: each round is one join of the last level with the rows, so a
    thread's size does not matter; replies to missing posts vanish with their root.
    """
    base = rows.select(F.col(thread).alias("t"), F.col(node).alias("n"), F.col(parent).alias("p")).where("t IS NOT NULL AND n IS NOT NULL").distinct()
    step = base.where("p IS NULL").select("t", "n", F.lit(0).alias("depth"), F.lpad(F.col("n").cast("string"), DIGITS, "0").alias("path"))
    out = step
    for k in range(1, deepest):
        up = step.select("t", F.col("n").alias("p"), F.col("path").alias("up"))
        step = base.join(up, ["t", "p"]).select("t", "n", F.lit(k).alias("depth"), F.concat_ws("/", "up", F.lpad(F.col("n").cast("string"), DIGITS, "0")).alias("path"))
        out = out.unionByName(step)
    return out.select(F.col("t").alias(thread), F.col("n").alias(node), "depth", "path")
