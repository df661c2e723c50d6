"""Keys that hold half of all rows, and the persisted index."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sheaf.operators import index, state, timed
from sheaf.operators.search import bm25
from sheaf.session import checkpoint_dir

DOCS = [(i, " ".join(w for k, w in enumerate("river stone harbour light paper".split()) if i % (k + 2) == 0) or None) for i in range(60)]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    docs = spark.createDataFrame(DOCS, "id long, t string")
    path = str(tmp_path_factory.mktemp("index") / "i")
    for part in range(3):
        assert index.add(docs.where(f"id % 3 = {part}"), "id", "t", path) == part
    return docs, path


def test_an_index_in_batches_scores_like_a_scan(spark, built):
    docs, path = built
    for query in (["river"], ["stone", "paper"], ["none"], ["LIGHT", "light"]):
        assert [(r.key, r.score) for r in index.bm25(spark, path, query).collect()] == [(r.id, r.score) for r in bm25(docs, "id", "t", query).collect()]


def test_a_query_reads_only_its_buckets_and_terms(spark, built):
    plan = index.bm25(spark, built[1], ["river"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "EqualTo(term,river)" in plan or "In(term" in plan


def test_keys_that_are_indexed_stay(spark, built):
    docs, path = built
    index.add(docs.withColumn("t", F.lit("other words")), "id", "t", path)
    assert index.bm25(spark, path, ["other"]).collect() == []


def hot(spark, n=6000):
    rows = [("hot" if i % 2 else f"v{i % 37}", i, round(i * 1.7 + (30 if i % 97 == 0 else 0), 2), 1.0 + i % 3 / 4) for i in range(n)]
    return spark.createDataFrame(rows, "v string, i0 int, start double, duration double")


def test_gaps_over_stretches_are_those_over_videos(spark):
    s = hot(spark)
    w = Window.partitionBy("v").orderBy("start", "i0")
    plain = {(r.v, r.i0): r.g for r in s.withColumn("g", F.lead("start").over(w) - (F.col("start") + F.col("duration"))).collect()}
    assert {(r.v, r.i0): r.gap for r in timed.gaps(s, "v", ["start", "i0"]).collect()} == plain
    at = {(r.v, r.i0): r.k for r in s.withColumn("k", F.row_number().over(w) - 1).collect()}
    assert {(r.v, r.i0): r.i for r in timed.positions(s, "v", ["start", "i0"]).collect()} == at


def test_outliers_over_blocks(spark):
    import statistics

    s = hot(spark)
    got = {(r.v, r.i0) for r in timed.outlier_gaps(s, "v", ["start", "i0"]).where("outlier").collect()}
    videos = {}
    for r in sorted(s.collect(), key=lambda r: (r.v, r.start, r.i0)):
        videos.setdefault(r.v, []).append(r)
    want = set()
    for v, rows in videos.items():
        gaps = [b.start - (a.start + a.duration) for a, b in zip(rows, rows[1:])]
        for i, g in enumerate(gaps):
            near = gaps[max(i - 5, 0) : max(i - 5, 0) + 10]
            if g >= (3.0 if len(gaps) < 10 else max(2 * statistics.median(near), 1.5)):
                want.add((v, rows[i].i0))
    assert got == want and want


def test_a_limiter_over_stretches(spark):
    rows = [("hot" if i % 3 else f"u{i % 7}", i, float((i * 7919) % 5000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "u string, id int, t double")
    got = {r.id: r.granted for r in state.granted(df, "u", F.col("t"), ["t", "id"], 3.0, span=200.0).collect()}
    last, want = {}, {}
    for u, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        last[u] = want[i] = t if u not in last else max(t, last[u] + 3.0)
    assert got == pytest.approx(want)


def test_checkpoints_go_to_the_named_folder(spark):
    assert checkpoint_dir(spark)
