"""A persisted inverted index: postings as a table, written in batches, pruned by term.

``postings`` holds (key, term, tf, len), in folders by batch and by the bucket of
the term; within a file rows are sorted by term, so that a query reads the row
groups of its terms only. A term that very many texts hold is spread over as
many files as its batch has splits. ``texts`` holds one row for each batch with
the number of texts and of terms, so statistics cost no scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators.search import K1, B, terms

BUCKETS = 64


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def batches(spark: SparkSession, path: str) -> int:
    """How many batches an index has; 0 if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/texts")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return 0
    return spark.read.parquet(f"{path}/texts").agg(F.coalesce(F.max("batch") + 1, F.lit(0))).first()[0]


def add(docs: DataFrame, key: str, text: str, path: str, splits: int = 4) -> int:
    """Index a batch of texts; returns its number. A key that is indexed already is left as it is.

    Term frequencies are counted inside each row, so a text's terms are never
    shuffled as single words; null texts count as empty ones.
    """
    spark = docs.sparkSession
    number = batches(spark, path)
    new = docs.select(F.col(key).alias("key"), F.coalesce(terms(F.col(text)), F.array().cast("array<string>")).alias("w")).where("key IS NOT NULL").dropDuplicates(["key"])
    if number:
        new = new.join(spark.read.parquet(f"{path}/keys").select("key"), "key", "left_anti")
    sized = new.select("key", F.size("w").cast("long").alias("len"), "w")
    sized.select("key", "len").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/keys/batch={number}")
    each = sized.select("key", "len", F.explode(F.array_sort("w")).alias("term")).groupBy("key", "len", "term").agg(F.count("*").alias("tf"))
    placed = each.withColumn("bucket", _bucket(F.col("term"))).repartition(F.col("bucket"), F.pmod(F.xxhash64("key"), F.lit(splits)))
    placed.sortWithinPartitions("bucket", "term", "key").select("bucket", "term", "key", "tf", "len").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={number}")
    counted = spark.read.parquet(f"{path}/keys/batch={number}").agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("len"))
    counted.withColumn("batch", F.lit(number)).coalesce(1).write.mode("append").parquet(f"{path}/texts")
    return number


def bm25(spark: SparkSession, path: str, query: list[str], limit: int | None = 50) -> DataFrame:
    """(key, score) of the texts that hold any of the terms, best first, ties by key: what search.bm25 gives.

    Only the buckets of the terms are read, and in them the terms' rows.
    """
    query = list(dict.fromkeys(q.lower() for q in query))
    asked = spark.createDataFrame([(q,) for q in query], "term string")
    buckets = [r.b for r in asked.select(_bucket(F.col("term")).alias("b")).distinct().toLocalIterator()]  # as many as terms at most
    rows = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(query))
    texts = spark.read.parquet(f"{path}/texts").agg(F.sum("n").cast("double").alias("n"), (F.sum("len") / F.sum("n")).alias("avg"))
    df = rows.groupBy("term").agg(F.count("*").cast("double").alias("df")).join(F.broadcast(texts))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    t = F.col("tf").cast("double")
    score = idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    # one row for each term of the query
    hits = rows.join(F.broadcast(df), "term").groupBy("key").agg(F.round(F.sum(score), 6).alias("score"))
    return hits.orderBy(F.desc("score"), "key").limit(limit) if limit is not None else hits
