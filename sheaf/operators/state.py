"""State that follows the order of requests: caches, limiter, ledgers. Batch forms over traces."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class TwoQueues:
    """New keys wait in probation, first in first out; a key asked for again is protected, least
    recently used last. Probation is evicted first; keys of one group go together."""

    def __init__(self, most: int = 8):
        self.most, self.probation, self.protected = most, OrderedDict(), OrderedDict()

    def __contains__(self, key) -> bool:
        return key in self.probation or key in self.protected

    def get(self, key, renderer=None) -> bool:
        for queue in (self.protected, self.probation):
            if key in queue:
                if renderer is not None and queue[key][0] != renderer:
                    return False
                self.protected[key] = queue.pop(key)
                return True
        return False

    def store(self, key, renderer=None, group=None) -> list:
        gone = []
        for queue in (self.protected, self.probation):
            if key in queue:
                queue[key] = (renderer, group)
                queue.move_to_end(key)
                return gone
        while len(self.probation) + len(self.protected) >= self.most:
            queue = self.probation or self.protected
            first = next(iter(queue))
            group_of = queue[first][1]
            for q in (self.probation, self.protected):
                for k in [k for k, v in q.items() if k == first or (group_of is not None and v[1] == group_of)]:
                    del q[k]
                    gone.append(k)
        self.probation[key] = (renderer, group)
        return gone


def _replay(most: int, promote: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, cache = None, None
        for batch in batches:
            hits, evicted = [], []
            for who, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if who != owner:
                    owner, cache = who, TwoQueues(most)
                hit = cache.get(key) if promote else key in cache
                hits.append(hit)
                evicted.append(None if hit else ",".join(map(str, cache.store(key))) or None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.bool_()), pa.array(evicted, pa.string())], names=[*batch.schema.names, "hit", "evicted"])

    return run


def cache_trace(requests: DataFrame, owner: str, key: str, order: list[str], most: int = 8, promote: bool = True) -> DataFrame:
    """Adds hit and evicted to each request of each owner's cache. The trace is replayed over sorted
    partitions as a stream: memory holds one cache."""
    kinds = dict(requests.dtypes)
    ids = [c for c in order if c not in (owner, key)]
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in (owner, key, *ids)) + ", hit boolean, evicted string"
    return requests.repartition(owner).sortWithinPartitions(owner, *order).select(owner, key, *ids).mapInArrow(_replay(most, promote), ddl)


def grouped_trace(requests: DataFrame, owner: str, key: str, group: str, order: list[str], most: int = 8) -> DataFrame:
    """Adds hit and evicted to each request, for a cache whose keys of one group leave together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, cache = None, None
        for batch in batches:
            hits, gone = [], []
            for o, k, g in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if o != who:
                    who, cache = o, TwoQueues(most)
                hits.append(cache.get(k))
                gone.append(None if hits[-1] else ",".join(map(str, cache.store(k, group=g))) or None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.bool_()), pa.array(gone, pa.string())], names=[*batch.schema.names, "hit", "evicted"])

    kinds = dict(requests.dtypes)
    columns = [owner, key, group, *[c for c in order if c not in (owner, key, group)]]
    return requests.repartition(owner).sortWithinPartitions(owner, *order).select(*columns).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", hit boolean, evicted string")


def granted(requests: DataFrame, owner: str, at: Column, order: list, interval: float, span: float | None = None) -> DataFrame:
    """Adds granted: when a limiter with a least interval lets each request pass. Closed form of
    t' = max(t, last + d): n d + the running maximum of t - j d.

    ``order`` begins with what ``at`` is made of. Counts and maxima are taken
    within stretches of ``span`` (1,000 intervals), and those of the stretches
    before come from one row for each, so an owner's requests are many sorts.
    """
    span = span or interval * 1000
    r = requests.withColumn("_t", at).withColumn("_c", F.floor(F.col("_t") / span))
    past = Window.partitionBy(owner).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(owner, "_c").orderBy(*order)
    counts = r.groupBy(owner, "_c").agg(F.count("*").alias("_k")).withColumn("_o", F.coalesce(F.sum("_k").over(past), F.lit(0))).drop("_k")
    r = r.withColumn("_i", F.row_number().over(inside) - 1).join(counts, [owner, "_c"]).withColumn("_n", F.col("_i") + F.col("_o")).withColumn("_v", F.col("_t") - F.col("_n") * interval)
    tops = r.groupBy(owner, "_c").agg(F.max("_v").alias("_top")).withColumn("_before", F.max("_top").over(past)).drop("_top")
    high = F.max("_v").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumn("_high", high).join(tops, [owner, "_c"]).withColumn("granted", F.col("_n") * interval + F.greatest("_high", "_before")).drop("_t", "_c", "_i", "_o", "_n", "_v", "_high", "_before")


def fires(events: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Adds fires: whether a tip is shown, which it is once for each key: at its first event, found by one
    map-side combined aggregation. Events of one key that agree in all of ``order`` fire together."""
    first = events.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    return events.join(first, keys).withColumn("fires", F.struct(*order) == F.col("_first")).drop("_first")
