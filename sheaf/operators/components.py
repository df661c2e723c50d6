"""Connected components over memberships (row id, key) without pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import cut


def components(members: DataFrame, id_col: str, key_col: str) -> DataFrame:
    """(id, component): ids that share keys, directly or over others; the component is its least id.

    Each round takes the least label of every key and gives it to the key's
    ids: two map-side combined aggregations and a join on the key, so a hot key
    costs one row for each map task before the join, and AQE splits it there.
    Pointer jumping over the labels shortens long chains. Rows with a null id or
    key are ignored; every id in ``members`` comes out once.
    """
    edges = cut(members.where(F.col(id_col).isNotNull() & F.col(key_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(key_col).alias("key")).distinct())
    labels = cut(edges.select("id").distinct().withColumn("label", F.col("id")))
    while True:  # labels only fall, and pointer jumping makes the rounds as many as the logarithm of the longest chain
        by_key = edges.join(labels, "id").groupBy("key").agg(F.min("label").alias("least"))
        near = edges.join(by_key, "key").groupBy("id").agg(F.min("least").alias("near"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("to"))
        jump = step.select(F.col("id").alias("to"), F.col("to").alias("over"))
        new = cut(step.join(jump, "to", "left").select("id", "label", F.least("to", F.coalesce("over", "to")).alias("to")))
        changed = new.where("label <> to").limit(1).count()
        labels = new.select("id", F.col("to").alias("label"))
        if not changed:
            break
    return labels.select(F.col("id").alias(id_col), F.col("label").alias("component"))
