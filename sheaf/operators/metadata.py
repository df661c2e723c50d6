"""Joins and aggregates over metadata payloads: packages, checkpoints, notices, captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_topic(posts: DataFrame, topics: DataFrame) -> DataFrame:
    """Search posts beside their topic's title and replies; defaults where a topic is missing."""
    return posts.join(topics, "topic_id", "left").withColumn("title", F.coalesce("title", F.lit("Untitled"))).withColumn("replies", F.coalesce("replies", F.lit(0)))


def citation_key(key: Column) -> Column:
    """A citation anchor id from any way of writing it."""
    bare = F.regexp_replace(key, r"^#+", "")
    return F.when(bare.startswith("CITEREF"), bare).otherwise(F.concat(F.lit("CITEREF"), bare))


def requested(wanted: DataFrame, available: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What is there of what was asked, and what is not."""
    return available.join(wanted.select(key).distinct(), key, "left_semi"), wanted.join(available.select(key), key, "left_anti")


def missing_posts(stream: DataFrame, inline: DataFrame) -> DataFrame:
    """Ids of a topic's stream that did not come with it."""
    return stream.join(inline.select("post_id"), "post_id", "left_anti")


def dependency_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Direct and other dependencies with their requirement: of several edges to a node the last
    with a requirement counts, and equal nodes share the first one's."""
    last = edges.where("requirement <> ''").groupBy(F.col("to_node").alias("first")).agg(F.max_by("requirement", "edge_pos").alias("requirement"))
    alike = Window.partitionBy("name", "version", "relation")
    return nodes.where("relation <> 'SELF'").withColumn("first", F.min("node").over(alike)).join(last, "first", "left").select("node", "name", "version", "relation", F.coalesce("requirement", F.lit("")).alias("requirement"))


# fixed values: how sharded weight files are named
SHARD = r"^(.*)-(\d+)-of-(\d+)\.safetensors$"
PRECISION = r"\.(?:fp16|bf16|fp32|fp8|int8)\.safetensors$"


def checkpoint_files(siblings: DataFrame) -> DataFrame:
    """Weight files with their directory and group: of-N for the shards of one stem, else singles.

    Shards of several stems in a directory are single weights that were split, so
    they belong to the singles. Files in a lower precision go if the full file is there.
    """
    w = siblings.where(F.col("name").endswith(".safetensors"))
    full = w.select("repo", F.col("name").alias("full"))
    w = w.withColumn("full", F.when(F.col("name").rlike(PRECISION), F.regexp_replace("name", PRECISION, ".safetensors"))).join(full, ["repo", "full"], "left_anti").drop("full")
    base = F.element_at(F.split("name", "/"), -1)
    w = w.withColumn("dir", F.regexp_replace(F.regexp_replace("name", r"[^/]*$", ""), "/$", "")).withColumn("total", F.regexp_extract(base, SHARD, 3)).withColumn("stem", F.regexp_extract(base, SHARD, 1))
    group = F.when(F.col("total") == "", "singles").otherwise(F.concat(F.lit("of-"), F.col("total").cast("int").cast("string")))
    w = w.withColumn("grp", group)
    stems = Window.partitionBy("repo", "dir", "grp")
    many = F.min("stem").over(stems) != F.max("stem").over(stems)
    return w.withColumn("grp", F.when((F.col("grp") != "singles") & many, "singles").otherwise(F.col("grp")))


def checkpoint_sets(siblings: DataFrame) -> DataFrame:
    """Files and bytes of each candidate set, its label, and whether it is the checkpoint: at the top
    rather than below, sharded rather than single files, with more files rather than fewer."""
    f = checkpoint_files(siblings)
    s = f.groupBy("repo", "dir", "grp").agg(F.count("*").alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"), F.min("name").alias("first_name"), F.max((F.col("total") != "").cast("int")).alias("sharded"))
    where = F.when(F.col("dir") == "", "top-level").otherwise(F.col("dir"))
    count = F.col("files").cast("string")
    label = (
        F.when(F.col("grp") != "singles", F.concat(where, F.lit(" ("), count, F.lit(" files, "), "grp", F.lit(")")))
        .when(F.col("files") == 1, F.concat(where, F.lit("/"), F.element_at(F.split("first_name", "/"), -1)))
        .when(F.col("sharded") == 1, F.concat(where, F.lit(" ("), count, F.lit(" per-file weights)")))
        .otherwise(F.concat(where, F.lit(" ("), count, F.lit(" unsharded files)")))
    )
    order = Window.partitionBy("repo").orderBy(F.col("dir") != "", F.col("grp") == "singles", F.desc("files"), "dir", "grp")
    return s.withColumn("label", label).withColumn("canonical", F.row_number().over(order) == 1).drop("first_name", "sharded")


def bits_per_weight(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """(repo, params, bytes, bpw) of the checkpoint against the histogram of its number types."""
    p = counts.groupBy("repo").agg(F.sum("n").alias("params"))
    return sets.where("canonical").select("repo", "bytes").join(p, "repo").select("repo", "params", "bytes", F.round(F.col("bytes") * 8 / F.col("params"), 2).alias("bpw"))


def fingerprint(counts: DataFrame) -> DataFrame:
    """(repo, text): number types of at least half a percent, the four largest."""
    from sheaf.functions.text import human_count

    per = Window.partitionBy("repo")
    share = counts.withColumn("share", F.col("n") / F.sum("n").over(per))
    big = share.where("share >= 0.005").withColumn("k", F.row_number().over(per.orderBy(F.desc("n"), "dtype"))).where("k <= 4")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("k", F.concat("dtype", F.lit(" "), human_count(F.col("n"))).alias("t")))), lambda x: x["t"])
    return big.groupBy("repo").agg(F.array_join(parts, " + ").alias("text"))


# fixed values: kinds of update notices
RETRACTIONS, CONCERNS = ("retraction", "withdrawal", "removal", "partial_retraction"), ("expression_of_concern",)
CORRECTIONS = ("correction", "corrigendum", "erratum", "addendum", "clarification")


def notice_class(kind: Column) -> Column:
    k = F.lower(F.trim(kind))
    return F.when(k.isin(*RETRACTIONS), "retraction").when(k.isin(*CONCERNS), "expression_of_concern").when(k.isin(*CORRECTIONS), "correction")


def update_notices(entries: DataFrame) -> DataFrame:
    """(doi, class, notice_doi, date): of each work the latest notice of its gravest class."""
    c = entries.withColumn("class", notice_class(F.col("kind"))).where("class IS NOT NULL")
    rank = F.when(F.col("class") == "retraction", 3).when(F.col("class") == "expression_of_concern", 2).otherwise(1)
    best = F.max_by(F.struct("class", "notice_doi", "date"), F.struct(rank, F.coalesce("date", F.lit("0000")), -F.col("pos")))
    return c.groupBy("doi").agg(best.alias("n")).select("doi", "n.*")


def alert(n: DataFrame) -> DataFrame:
    """Adds alert (retractions and concerns) and note (corrections)."""
    tail = [F.col("date"), F.concat(F.lit("— notice: "), "notice_doi")]
    verb = F.when(F.col("class") == "retraction", "retracted").when(F.col("class") == "expression_of_concern", "expression of concern")
    return n.withColumn("alert", F.when(verb.isNotNull(), F.concat_ws(" ", verb, *tail))).withColumn("note", F.when(F.col("class") == "correction", F.concat_ws(" ", F.lit("correction published"), *tail)))


def weak_checks(checks: DataFrame) -> DataFrame:
    """(project, check, score, above): checks of five points or less, the worst first, and how many are above."""
    per = Window.partitionBy("project")
    weak = F.col("score").between(0, 5)
    return checks.withColumn("above", (F.count("*").over(per) - F.sum(weak.cast("int")).over(per)).cast("bigint")).where(weak).withColumn("k", F.row_number().over(per.orderBy("score", "pos"))).select("project", "k", "check", "score", "above")


def latest_versions(versions: DataFrame, most: int = 20) -> DataFrame:
    """The newest versions of each package, null dates last."""
    k = F.row_number().over(Window.partitionBy("package").orderBy(F.desc_nulls_last("published"), F.desc("version")))
    return versions.withColumn("k", k).where(F.col("k") <= most)


def caption_inventory(tracks: DataFrame) -> DataFrame:
    """Per video: languages spoken (uploaded or recognised), uploaded, available; whether any is translated
    and whether all are automatic."""
    manual, auto = F.col("kind") == "manual", F.col("kind") == "auto"
    translated = auto & F.coalesce(F.col("url").contains("tlang="), F.lit(False))
    langs = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("lang")))), ",")
    return tracks.groupBy("video").agg(langs(manual | (auto & ~translated)).alias("source"), langs(manual).alias("uploaded"), langs(F.lit(True)).alias("available"), F.max(translated).alias("auto_translated"), (F.max(auto) & ~F.max(manual)).alias("auto_only"))


def caption_track(tracks: DataFrame, wanted: list[str]) -> DataFrame:
    """(video, lang, generated): the first wanted language among uploaded tracks, else among automatic ones."""
    rank = F.array_position(F.array(*map(F.lit, wanted)), F.col("lang"))
    best = F.min_by(F.struct("lang", (F.col("kind") == "auto").alias("generated")), F.struct(F.col("kind") == "auto", rank))
    return tracks.where(rank > 0).groupBy("video").agg(best.alias("t")).select("video", "t.*")
