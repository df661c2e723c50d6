"""Joins, aggregates, rankings and set operations over metadata rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.operators import metadata as md
from sheaf.plans.fixtures import inline, values
from sheaf.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _q(name: str, sql: str):
    def add(fn):
        QUERIES[name], SQL[name] = fn, sql
        return fn

    return add


POSTS, TOPICS = [(1, 10), (2, 11), (3, 99), (4, None)], [(10, "Ten", 5), (11, "Eleven", None)]
_P, _T = "(" + values(POSTS, "post_id", "topic_id") + ")", "(" + values(TOPICS, "topic_id", "title", "replies") + ")"


@_q("j1_post_topics", f"SELECT post_id, coalesce(title, 'Untitled') AS title, coalesce(replies, 0) AS replies FROM {_P} p LEFT JOIN {_T} t USING (topic_id)")
def j1(spark: SparkSession, d: str) -> DataFrame:
    return md.with_topic(inline(spark, POSTS, "post_id long, topic_id long"), inline(spark, TOPICS, "topic_id long, title string, replies long")).select("post_id", "title", "replies")


KEYS, HAVE = [("#CITEREFFoo2005",), ("Bar1999",), ("CITEREFNone",)], [("CITEREFFoo2005", "Foo"), ("CITEREFBar1999", "Bar"), ("CITEREFBaz", "Baz")]


@_q("j2_citations", "SELECT * FROM (VALUES ('CITEREFFoo2005', true), ('CITEREFBar1999', true), ('CITEREFNone', false)) AS t(key, found)")
def j2(spark: SparkSession, d: str) -> DataFrame:
    want = inline(spark, KEYS, "k string").select(md.citation_key(F.col("k")).alias("key"))
    there, lost = md.requested(want, inline(spark, HAVE, "key string, text string"), "key")
    return there.select("key", F.lit(True).alias("found")).unionByName(lost.select("key", F.lit(False).alias("found")))


@_q("j3_missing_posts", "SELECT event_id AS post_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def j3(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("post_id"), "event_type")
    return md.missing_posts(e.select("post_id"), e.where("event_type = 'click'"))


NODES = [(0, "root", "1", "SELF"), (1, "a", "1", "DIRECT"), (2, "b", "2", "DIRECT"), (3, "c", "3", "INDIRECT"), (4, "a", "1", "DIRECT")]
EDGES = [(0, 1, "^1"), (1, 2, ""), (2, 1, "~1.1"), (3, 3, ">=3"), (4, 4, "==9")]
_ND, _ED = "(" + values(NODES, "node", "name", "version", "relation") + ")", "(" + values(EDGES, "edge_pos", "to_node", "requirement") + ")"


@_q("j4_dependencies", f"SELECT n.node, name, version, relation, coalesce((SELECT arg_max(requirement, edge_pos) FROM {_ED} e WHERE e.to_node = (SELECT min(m.node) FROM {_ND} m WHERE m.name = n.name AND m.version = n.version AND m.relation = n.relation) AND requirement <> ''), '') AS requirement FROM {_ND} n WHERE relation <> 'SELF'")
def j4(spark: SparkSession, d: str) -> DataFrame:
    return md.dependency_rows(inline(spark, NODES, "node long, name string, version string, relation string"), inline(spark, EDGES, "edge_pos long, to_node long, requirement string"))


@_q("a8_relation_counts", f"SELECT count(*) FILTER (relation = 'DIRECT') AS direct, count(*) FILTER (relation NOT IN ('DIRECT', 'SELF')) AS transitive FROM {_ND}")
def a8(spark: SparkSession, d: str) -> DataFrame:
    n = inline(spark, NODES, "node long, name string, version string, relation string")
    return n.agg(F.count_if(F.col("relation") == "DIRECT").alias("direct"), F.count_if(~F.col("relation").isin("DIRECT", "SELF")).alias("transitive"))


@_q("j5_author_orcids", "SELECT record_id, a AS author, CASE WHEN orcids IS NOT NULL THEN map_extract_value(orcids, a) END AS orcid FROM (SELECT record_id, unnest(authors) AS a, orcids FROM (SELECT record_id, any_value(authors) AS authors, any_value(orcids) AS orcids FROM citation_records GROUP BY record_id)) WHERE a IS NOT NULL")
def j5(spark: SparkSession, d: str) -> DataFrame:
    # a map column cannot be grouped by its value, so the first row of a re-delivered record stands for all
    r = table(spark, d, "citation_records").dropDuplicates(["record_id"]).select("record_id", "authors", "orcids")
    return r.select("record_id", F.explode("authors").alias("author"), "orcids").where("author IS NOT NULL").select("record_id", "author", F.try_element_at("orcids", F.col("author")).alias("orcid"))


_CR = "(SELECT record_id, any_value(doi) AS doi, any_value(alt_dois) AS alt_dois, any_value(added) AS added, any_value(confirmed) AS confirmed, any_value(retraction) AS retraction, any_value(year) AS year, any_value(title) AS title, any_value(source_tool) AS source_tool, any_value(score) AS score FROM citation_records GROUP BY record_id)"


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "citation_records").dropDuplicates(["record_id"])


@_q("j11_shared_doi", f"WITH k AS (SELECT DISTINCT record_id, unnest(list_distinct(list_concat([doi], coalesce(alt_dois, [])))) AS k FROM {_CR}), g AS (SELECT k, min(record_id) AS least, count(*) AS n FROM k WHERE k IS NOT NULL GROUP BY k) SELECT k.record_id, min(least) AS matched, count(*) FILTER (n > 1) AS shared FROM k JOIN g USING (k) GROUP BY k.record_id")
def j11(spark: SparkSession, d: str) -> DataFrame:
    """Each record with the least record that shares a DOI with it, as typed, and how many of its DOIs
    others have. A star for each DOI: no pairs, whatever number of records names one."""
    k = _records(spark, d).select("record_id", F.explode(F.array_distinct(F.concat(F.array("doi"), F.coalesce("alt_dois", F.array().cast("array<string>"))))).alias("k")).where("k IS NOT NULL")
    g = k.groupBy("k").agg(F.min("record_id").alias("least"), F.count("*").alias("n"))
    return k.join(g, "k").groupBy("record_id").agg(F.min("least").alias("matched"), F.count_if(F.col("n") > 1).alias("shared"))


SIBS = [("r1", "model-00001-of-00002.safetensors", 100), ("r1", "model-00002-of-00002.safetensors", 120), ("r1", "original/consolidated.safetensors", 300), ("r1", "config.json", 1), ("r2", "a_fc-00001-of-00002.safetensors", 5), ("r2", "a_fc-00002-of-00002.safetensors", 6), ("r2", "b_fc-00001-of-00002.safetensors", 7), ("r2", "b_fc-00002-of-00002.safetensors", None), ("r2", "c.safetensors", 9), ("r3", "unet/m.safetensors", 20), ("r3", "unet/m.fp16.safetensors", 10), ("r3", "only.fp16.safetensors", 4)]
_SB = "(" + values(SIBS, "repo", "name", "size") + ")"
_SETS = f"""(WITH w AS (SELECT * FROM {_SB} WHERE ends_with(name, '.safetensors')),
k AS (SELECT * FROM w WHERE NOT (regexp_matches(name, '{md.PRECISION}') AND EXISTS (SELECT 1 FROM w f WHERE f.repo = w.repo AND f.name = regexp_replace(w.name, '{md.PRECISION}', '.safetensors')))),
p AS (SELECT *, regexp_replace(regexp_replace(name, '[^/]*$', ''), '/$', '') AS dir, regexp_extract(list_last(string_split(name, '/')), '{md.SHARD}', 3) AS total, regexp_extract(list_last(string_split(name, '/')), '{md.SHARD}', 1) AS stem FROM k),
g AS (SELECT *, CASE WHEN total = '' THEN 'singles' ELSE 'of-' || CAST(CAST(total AS INT) AS VARCHAR) END AS g0 FROM p),
h AS (SELECT *, CASE WHEN g0 <> 'singles' AND min(stem) OVER (PARTITION BY repo, dir, g0) <> max(stem) OVER (PARTITION BY repo, dir, g0) THEN 'singles' ELSE g0 END AS grp FROM g),
s AS (SELECT repo, dir, grp, count(*) AS files, CAST(sum(coalesce(size, 0)) AS BIGINT) AS bytes, min(name) AS nm, max(CAST(total <> '' AS INT)) AS sharded FROM h GROUP BY repo, dir, grp)
SELECT repo, dir, grp, files, bytes, CASE WHEN grp <> 'singles' THEN CASE WHEN dir = '' THEN 'top-level' ELSE dir END || ' (' || files || ' files, ' || grp || ')' WHEN files = 1 THEN CASE WHEN dir = '' THEN 'top-level' ELSE dir END || '/' || list_last(string_split(nm, '/')) WHEN sharded = 1 THEN CASE WHEN dir = '' THEN 'top-level' ELSE dir END || ' (' || files || ' per-file weights)' ELSE CASE WHEN dir = '' THEN 'top-level' ELSE dir END || ' (' || files || ' unsharded files)' END AS label,
 row_number() OVER (PARTITION BY repo ORDER BY dir <> '', grp = 'singles', files DESC, dir, grp) = 1 AS canonical FROM s)"""


def _sets(spark: SparkSession) -> DataFrame:
    return md.checkpoint_sets(inline(spark, SIBS, "repo string, name string, size long"))


@_q("a2_checkpoint_sets", f"SELECT repo, dir, grp, files, bytes, label, canonical FROM {_SETS}")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return _sets(spark)


@_q("a3_canonical_set", f"SELECT repo, dir, grp FROM {_SETS} WHERE canonical")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return _sets(spark).where("canonical").select("repo", "dir", "grp")


@_q("j13_precision_variants", f"SELECT name FROM {_SB} w WHERE ends_with(name, '.safetensors') AND NOT (regexp_matches(name, '{md.PRECISION}') AND EXISTS (SELECT 1 FROM {_SB} f WHERE f.repo = w.repo AND f.name = regexp_replace(w.name, '{md.PRECISION}', '.safetensors')))")
def j13(spark: SparkSession, d: str) -> DataFrame:
    return md.checkpoint_files(inline(spark, SIBS, "repo string, name string, size long")).select("name")


DT = [("r1", "BF16", 100), ("r1", "F32", 10), ("r1", "I64", 0), ("r2", "U8", 30_000_000), ("r2", "F16", 2_000_000_000), ("r2", "F32", 100), ("r3", "F16", 16)]
_DTS = "(" + values(DT, "repo", "dtype", "n") + ")"


@_q("a7_bits_per_weight", f"SELECT repo, CAST(p.params AS BIGINT) AS params, bytes, round(bytes * 8 / p.params, 2) AS bpw FROM {_SETS} s JOIN (SELECT repo, sum(n) AS params FROM {_DTS} GROUP BY repo) p USING (repo) WHERE canonical")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return md.bits_per_weight(_sets(spark), inline(spark, DT, "repo string, dtype string, n long"))


@_q("a20_fingerprint", f"SELECT repo, string_agg(dtype || ' ' || CASE WHEN n >= 1e9 THEN printf('%.1fB', n / 1e9) WHEN n >= 1e6 THEN printf('%.1fM', n / 1e6) ELSE format('{{:,}}', n) END, ' + ' ORDER BY n DESC, dtype) AS text FROM (SELECT *, n / sum(n) OVER (PARTITION BY repo) AS share FROM {_DTS}) WHERE share >= 0.005 GROUP BY repo")
def a20(spark: SparkSession, d: str) -> DataFrame:
    return md.fingerprint(inline(spark, DT, "repo string, dtype string, n long"))


@_q("a1_tree_bytes", f"SELECT repo, CAST(sum(coalesce(size, 0)) AS BIGINT) AS bytes, count(*) AS files FROM {_SB} GROUP BY repo")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return inline(spark, SIBS, "repo string, name string, size long").groupBy("repo").agg(F.sum(F.coalesce("size", F.lit(0))).alias("bytes"), F.count("*").alias("files"))


@_q("a4_most_common", "SELECT language_code, n, row_number() OVER (ORDER BY n DESC, language_code) AS k FROM (SELECT coalesce(language_code, '') AS language_code, count(*) AS n FROM captions GROUP BY 1)")
def a4(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "captions").groupBy(F.coalesce("language_code", F.lit("")).alias("language_code")).agg(F.count("*").alias("n"))
    return c.withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "language_code")).cast("long"))  # a row for each language code


@_q("a5_counts", "SELECT site, count(*) AS docs, count(DISTINCT title) AS titles FROM documents GROUP BY site")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("site").agg(F.count("*").alias("docs"), F.count_distinct("title").alias("titles"))


@_q("a6_least_width", "SELECT * FROM (VALUES (1, 4), (2, 8), (3, NULL)) AS t(id, bits)")
def a6(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, [[8, 4], [16]]), (2, [[8]]), (3, [])], "id int, groups array<array<int>>")
    return rows.select("id", F.array_min(F.flatten("groups")).alias("bits"))


CHECKS = [("p", 1, "Fuzzing", 0), ("p", 2, "License", 10), ("p", 3, "Review", 5), ("p", 4, "Pinned", -1), ("q", 1, "License", 9)]


@_q("a9_weak_checks", "SELECT project, row_number() OVER (PARTITION BY project ORDER BY score, pos) AS k, \"check\", score, above FROM (SELECT *, count(*) OVER w - sum(CAST(score BETWEEN 0 AND 5 AS INT)) OVER w AS above FROM (" + values(CHECKS, "project", "pos", '"check"', "score") + ") WINDOW w AS (PARTITION BY project)) WHERE score BETWEEN 0 AND 5")
def a9(spark: SparkSession, d: str) -> DataFrame:
    return md.weak_checks(inline(spark, CHECKS, "project string, pos long, check string, score long"))


NOTES = [("10.1/a", 1, "correction", "10.1/c", "2020"), ("10.1/a", 2, "Retraction", "10.1/r1", "2020-05-22"), ("10.1/a", 3, "withdrawal", "10.1/r2", "2020-06-05"), ("10.1/b", 1, "erratum", "10.1/e", None), ("10.1/c", 1, "expression_of_concern", None, "2019-01"), ("10.1/d", 1, "new_version", "10.1/v", "2021")]
_NT = f"(WITH c AS (SELECT *, CASE WHEN lower(trim(kind)) IN {md.RETRACTIONS} THEN 'retraction' WHEN lower(trim(kind)) = 'expression_of_concern' THEN 'expression_of_concern' WHEN lower(trim(kind)) IN {md.CORRECTIONS} THEN 'correction' END AS class FROM (" + values(NOTES, "doi", "pos", "kind", "notice_doi", "date") + ")), r AS (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY CASE class WHEN 'retraction' THEN 3 WHEN 'expression_of_concern' THEN 2 ELSE 1 END DESC, coalesce(date, '0000') DESC, pos) AS k FROM c WHERE class IS NOT NULL) SELECT doi, class, notice_doi, date FROM r WHERE k = 1)"


def _notices(spark: SparkSession) -> DataFrame:
    return md.update_notices(inline(spark, NOTES, "doi string, pos long, kind string, notice_doi string, date string"))


@_q("a10_update_notice", f"SELECT doi, class, notice_doi, date FROM {_NT}")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return _notices(spark)


@_q("f35_alerts", f"SELECT doi, CASE WHEN class = 'retraction' THEN concat_ws(' ', 'retracted', date, '— notice: ' || notice_doi) WHEN class = 'expression_of_concern' THEN concat_ws(' ', 'expression of concern', date, '— notice: ' || notice_doi) END AS alert, CASE WHEN class = 'correction' THEN concat_ws(' ', 'correction published', date, '— notice: ' || notice_doi) END AS note FROM {_NT}")
def f35(spark: SparkSession, d: str) -> DataFrame:
    return md.alert(_notices(spark)).select("doi", "alert", "note")


RELS = [("10.1/a", "is-version-of", "doi", "10.1/X"), ("10.1/a", "has-preprint", "DOI", "10.1/x"), ("10.1/a", "cites", "doi", "10.9/n"), ("10.1/a", "has-version", "uri", "http://x"), ("10.1/b", "is-preprint-of", "doi", "bad")]


@_q("a11_relations", "SELECT doi, replace(bucket, '-', '_') AS bucket, string_agg(DISTINCT lower(trim(id)), ',' ORDER BY lower(trim(id))) AS dois FROM (" + values(RELS, "doi", "bucket", "id_type", "id") + ") WHERE bucket IN ('is-preprint-of', 'has-preprint', 'is-version-of', 'has-version') AND lower(id_type) = 'doi' AND regexp_matches(lower(trim(id)), '^10\\.\\d{1,9}/\\S+$') GROUP BY 1, 2")
def a11(spark: SparkSession, d: str) -> DataFrame:
    r = inline(spark, RELS, "doi string, bucket string, id_type string, id string").withColumn("v", F.lower(F.trim("id")))
    r = r.where(F.col("bucket").isin("is-preprint-of", "has-preprint", "is-version-of", "has-version") & (F.lower("id_type") == "doi") & F.col("v").rlike(r"^10\.\d{1,9}/\S+$"))
    return r.groupBy("doi", F.replace("bucket", F.lit("-"), F.lit("_")).alias("bucket")).agg(F.array_join(F.array_sort(F.collect_set("v")), ",").alias("dois"))


LICS = [(1, "https://a.test/l", "VOR"), (2, "ftp://x", "am"), (3, "http://b.test", None), (4, "http://c.test", "odd")]


@_q("a12_licenses", "SELECT id, url, CASE WHEN lower(coalesce(cv, '')) IN ('vor', 'am', 'tdm') THEN lower(cv) ELSE 'unspecified' END AS version FROM (" + values(LICS, "id", "url", "cv") + ") WHERE regexp_matches(url, '^https?://')")
def a12(spark: SparkSession, d: str) -> DataFrame:
    r = inline(spark, LICS, "id long, url string, cv string").where(F.col("url").rlike("^https?://"))
    return r.select("id", "url", F.when(F.lower("cv").isin("vor", "am", "tdm"), F.lower("cv")).otherwise("unspecified").alias("version"))


@_q("a13_shelf_counts", f"SELECT count(*) AS tracked, count(*) FILTER (confirmed) AS confirmed, count(*) FILTER (retraction IS NOT NULL) AS retracted FROM {_CR}")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).agg(F.count("*").alias("tracked"), F.count_if("confirmed").alias("confirmed"), F.count_if(F.col("retraction").isNotNull()).alias("retracted"))


NOTESTEXT = [(1, "a[^1] b[^2] c[^1]"), (2, "no notes"), (3, None), (4, "[^10][^9]")]


@_q("a15_footnotes", "SELECT id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(v, '\\[\\^(\\d+)\\]', 1), lambda x: CAST(x AS INT)))), ',') AS notes FROM (" + values(NOTESTEXT, "id", "v") + ")")
def a15(spark: SparkSession, d: str) -> DataFrame:
    r = inline(spark, NOTESTEXT, "id long, v string")
    nums = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("v", F.lit(r"\[\^(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))))
    return r.select("id", F.array_join(F.transform(nums, lambda x: x.cast("string")), ",").alias("notes"))


TRACKS = [("v1", "manual", "en", "u"), ("v1", "auto", "en", "u"), ("v1", "auto", "de", "u?tlang=de"), ("v2", "auto", "fr", None), ("v3", "manual", "es", "u")]
_TR = "(" + values(TRACKS, "video", "kind", "lang", "url") + ")"


@_q("a16_captions", f"SELECT video, coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang) FILTER (kind = 'manual' OR NOT coalesce(contains(url, 'tlang='), false)), '') AS source, coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang) FILTER (kind = 'manual'), '') AS uploaded, string_agg(DISTINCT lang, ',' ORDER BY lang) AS available, bool_or(kind = 'auto' AND coalesce(contains(url, 'tlang='), false)) AS auto_translated, bool_and(kind = 'auto') AS auto_only FROM {_TR} GROUP BY video")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return md.caption_inventory(inline(spark, TRACKS, "video string, kind string, lang string, url string"))


@_q("f37_caption_track", f"SELECT video, lang, kind = 'auto' AS generated FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY kind = 'auto', list_position(['de', 'fr', 'en'], lang)) AS k FROM {_TR} WHERE lang IN ('de', 'fr', 'en')) WHERE k = 1")
def f37(spark: SparkSession, d: str) -> DataFrame:
    return md.caption_track(inline(spark, TRACKS, "video string, kind string, lang string, url string"), ["de", "fr", "en"])


@_q("a17_grouped_comments", "SELECT user_id, min(event_id) AS first, count(*) AS n FROM events GROUP BY user_id")
def a17(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first"), F.count("*").alias("n"))


@_q("a18_sizes", "SELECT coalesce(renderer, 'none') AS queue, count(*) AS entries, CAST(sum(coalesce(n_chars, 0)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def a18(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.coalesce("renderer", F.lit("none")).alias("queue")).agg(F.count("*").alias("entries"), F.sum(F.coalesce("n_chars", F.lit(0))).cast("long").alias("chars"))


@_q("t3_latest_versions", "SELECT o_custkey AS package, o_orderkey AS version, k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS k FROM orders) WHERE k <= 3")
def t3(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("package"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("published"))
    return md.latest_versions(o, 3).select("package", "version", "k")


FILES = [("b.txt", "file", 2_097_152), ("dir", "dir", None), ("a.txt", "file", 10), ("z", "dir", None)]


@_q("t4_tree_order", "SELECT name, row_number() OVER (ORDER BY kind <> 'dir', name) AS k FROM (" + values(FILES, "name", "kind", "size") + ")")
def t4(spark: SparkSession, d: str) -> DataFrame:
    return inline(spark, FILES, "name string, kind string, size long").select("name", F.row_number().over(Window.orderBy(F.col("kind") != "dir", "name")).cast("long").alias("k"))  # one directory


@_q("t5_shelf_order", f"SELECT record_id FROM {_CR} ORDER BY coalesce(added, ''), record_id LIMIT 100")
def t5(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).orderBy(F.coalesce("added", F.lit("")), "record_id").limit(100).select("record_id")


@_q("t6_page", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def t6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").orderBy("doc_id").offset(100).limit(50)


@_q("t7_after_cursor", "SELECT doc_id FROM documents WHERE fetched_at IS NOT NULL AND (fetched_at, doc_id) > (TIMESTAMPTZ '2025-06-01 00:00:00+00', 0) ORDER BY fetched_at, doc_id LIMIT 25")
def t7(spark: SparkSession, d: str) -> DataFrame:
    at = F.lit("2025-06-01 00:00:00").cast("timestamp")
    return table(spark, d, "documents").where((F.col("fetched_at") > at) | ((F.col("fetched_at") == at) & (F.col("doc_id") > 0))).orderBy("fetched_at", "doc_id").limit(25).select("doc_id")


@_q("t8_first_and_more", "SELECT site, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (k <= 3) AS first, greatest(count(*) - 3, 0) AS more FROM (SELECT site, doc_id, row_number() OVER (PARTITION BY site ORDER BY doc_id) AS k FROM documents) GROUP BY site")
def t8(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "documents").withColumn("k", F.row_number().over(Window.partitionBy("site").orderBy("doc_id")))
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.col("doc_id")))), lambda x: x.cast("string")), ",")
    return k.groupBy("site").agg(first.alias("first"), F.greatest(F.count("*") - 3, F.lit(0)).alias("more"))


@_q("u1_doi_union", f"SELECT record_id, len(list_distinct(list_filter(list_concat([doi], coalesce(alt_dois, [])), lambda x: x IS NOT NULL))) AS dois, coalesce(list_contains(alt_dois, doi), false) AS own_again FROM {_CR}")
def u1(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    every = F.array_union(F.array("doi"), F.coalesce("alt_dois", F.array().cast("array<string>")))
    return r.select("record_id", F.size(F.filter(every, lambda x: x.isNotNull())).alias("dois"), F.coalesce(F.array_contains("alt_dois", F.col("doi")), F.lit(False)).alias("own_again"))


@_q("u2_except", "SELECT DISTINCT video_id FROM captions EXCEPT SELECT DISTINCT video_id FROM chapters")
def u2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "captions").select("video_id").subtract(table(spark, d, "chapters").select("video_id"))


@_q("u3_intersect", "SELECT video_id FROM captions INTERSECT SELECT video_id FROM chapters")
def u3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "captions").select("video_id").intersect(table(spark, d, "chapters").select("video_id"))


@_q("u4_union", f"SELECT record_id, 'active' AS bucket FROM {_CR} WHERE retraction IS NULL UNION ALL SELECT record_id, 'retracted' FROM {_CR} WHERE retraction IS NOT NULL")
def u4(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    pick = lambda c, b: r.where(c).select("record_id", F.lit(b).alias("bucket"))
    return pick("retraction IS NULL", "active").unionByName(pick("retraction IS NOT NULL", "retracted"))


@_q("u5_first_encounter", "SELECT url, min(doc_id) AS doc_id FROM documents WHERE url IS NOT NULL GROUP BY url")
def u5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("url IS NOT NULL").groupBy("url").agg(F.min("doc_id").alias("doc_id"))


@_q("w6_ranks", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) + 10 AS rank FROM documents")
def w6(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.desc_nulls_last("n_chars"), "doc_id")
    return table(spark, d, "documents").select("source", "doc_id", (F.row_number().over(w) + 10).alias("rank"))


@_q("w8_elapsed", "SELECT event_id, 'T+' || CASE WHEN s // 3600 < 100 THEN lpad(CAST(s // 3600 AS VARCHAR), 2, '0') ELSE CAST(s // 3600 AS VARCHAR) END || ':' || lpad(CAST((s % 3600) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS elapsed FROM (SELECT event_id, CAST(floor(epoch(CAST(ts AS TIMESTAMP))) - floor(epoch(min(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id))) AS BIGINT) AS s FROM events)")
def w8(spark: SparkSession, d: str) -> DataFrame:
    from sheaf.functions.text import elapsed

    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp")).withColumn("t0", F.min("t").over(Window.partitionBy("user_id")))
    return e.select("event_id", elapsed(F.col("t"), F.col("t0")).alias("elapsed"))


SEES = [(1, "RFC1; STD 97"), (2, "bcp0014"), (3, None), (4, "fyi 36")]


@_q("f19_subseries", "SELECT id, CASE WHEN m <> '' THEN upper(m) || ' ' || CAST(CAST(regexp_extract(v, '(?i)\\b(std|bcp|fyi)\\s*0*(\\d+)', 2) AS INT) AS VARCHAR) END AS label FROM (SELECT *, regexp_extract(v, '(?i)\\b(std|bcp|fyi)\\s*0*(\\d+)', 1) AS m FROM (" + values(SEES, "id", "v") + "))")
def f19(spark: SparkSession, d: str) -> DataFrame:
    r = inline(spark, SEES, "id long, v string")
    p = r"(?i)\b(std|bcp|fyi)\s*0*(\d+)"
    return r.select("id", F.when(F.col("v").rlike(p), F.concat(F.upper(F.regexp_extract("v", p, 1)), F.lit(" "), F.regexp_extract("v", p, 2).cast("int").cast("string"))).alias("label"))


HEADS = [(1, "60", "7", "1700"), (2, None, None, None), (3, "60", "20", "x")]


@_q("f22_rate_limit", "SELECT id, TRY_CAST(lim AS BIGINT) AS \"limit\", TRY_CAST(rem AS BIGINT) AS remaining, TRY_CAST(res AS BIGINT) AS reset, coalesce(TRY_CAST(rem AS BIGINT) < 10, false) AS low FROM (" + values(HEADS, "id", "lim", "rem", "res") + ")")
def f22(spark: SparkSession, d: str) -> DataFrame:
    r = inline(spark, HEADS, "id long, lim string, rem string, res string")
    h = F.create_map(F.lit("x-ratelimit-limit"), "lim", F.lit("x-ratelimit-remaining"), "rem", F.lit("x-ratelimit-reset"), "res")
    n = lambda k: F.try_element_at(h, F.lit(k)).try_cast("bigint")
    return r.select("id", n("x-ratelimit-limit").alias("limit"), n("x-ratelimit-remaining").alias("remaining"), n("x-ratelimit-reset").alias("reset"), F.coalesce(n("x-ratelimit-remaining") < 10, F.lit(False)).alias("low"))


SCORES = [(1, 7.5, "2024-01-02"), (2, 10.0, ""), (3, 6.0, None)]


@_q("f30_score", "SELECT id, regexp_replace(CAST(v AS VARCHAR), '\\.0$', '') || '/10' || CASE WHEN coalesce(day, '') <> '' THEN ' (@ ' || day || ')' ELSE '' END AS text FROM (" + values(SCORES, "id", "v", "day") + ")")
def f30(spark: SparkSession, d: str) -> DataFrame:
    r = inline(spark, SCORES, "id long, v double, day string")
    return r.select("id", F.concat(F.regexp_replace(F.col("v").cast("string"), r"\.0$", ""), F.lit("/10"), F.when(F.coalesce("day", F.lit("")) != "", F.concat(F.lit(" (@ "), "day", F.lit(")"))).otherwise("")).alias("text"))


@_q("f31_preprint_id", f"SELECT record_id, coalesce(CASE WHEN starts_with(doi, '10.48550/arXiv.') THEN substr(doi, 16) END, substr(list_filter(coalesce(alt_dois, []), lambda x: starts_with(x, '10.48550/arXiv.'))[1], 16)) AS arxiv FROM {_CR}")
def f31(spark: SparkSession, d: str) -> DataFrame:
    p = "10.48550/arXiv."
    alt = F.get(F.filter(F.coalesce("alt_dois", F.array().cast("array<string>")), lambda x: x.startswith(p)), F.lit(0))
    return _records(spark, d).select("record_id", F.substring(F.coalesce(F.when(F.col("doi").startswith(p), F.col("doi")), alt), len(p) + 1, 100).alias("arxiv"))


PEOPLE = [(1, "Sato", "Ana", None), (2, "", "Ana", None), (3, None, None, "The Group"), (4, "Sato", None, None), (5, None, None, None)]


@_q("f32_csl_author", "SELECT id, coalesce(nullif(lit, ''), CASE WHEN coalesce(fam, '') <> '' AND coalesce(giv, '') <> '' THEN fam || ', ' || giv ELSE coalesce(nullif(fam, ''), nullif(giv, ''), 'Unknown') END) AS name FROM (" + values(PEOPLE, "id", "fam", "giv", "lit") + ")")
def f32(spark: SparkSession, d: str) -> DataFrame:
    r = inline(spark, PEOPLE, "id long, fam string, giv string, lit string")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return r.select("id", F.coalesce(blank("lit"), F.concat(blank("fam"), F.lit(", "), blank("giv")), blank("fam"), blank("giv"), F.lit("Unknown")).alias("name"))


REACT = [(1, 3, 0, 2), (2, 0, 0, 0), (3, None, 1, None)]


@_q("f33_reactions", "SELECT id, concat_ws(' ', CASE WHEN up > 0 THEN '👍 ' || up END, CASE WHEN down > 0 THEN '👎 ' || down END, CASE WHEN eyes > 0 THEN '👀 ' || eyes END) AS text FROM (" + values(REACT, "id", "up", "down", "eyes") + ")")
def f33(spark: SparkSession, d: str) -> DataFrame:
    r = inline(spark, REACT, "id long, up long, down long, eyes long")
    part = lambda c, e: F.when(F.col(c) > 0, F.concat(F.lit(e + " "), F.col(c).cast("string")))
    return r.select("id", F.concat_ws(" ", part("up", "👍"), part("down", "👎"), part("eyes", "👀")).alias("text"))


QUANT = [(1, "gptq", 4, 4.13), (2, None, None, 8.0), (3, "mlx", 8, 6.2), (4, None, None, None)]


@_q("f34_quant_summary", "SELECT id, nullif(concat_ws(' · ', method, 'declared ' || bits || '-bit', 'effective ' || printf('%.2f', bpw) || ' bpw', CASE WHEN bpw < bits - 0.5 THEN 'mixed precision' END), '') AS text FROM (" + values(QUANT, "id", "method", "bits", "bpw") + ")")
def f34(spark: SparkSession, d: str) -> DataFrame:
    r = inline(spark, QUANT, "id long, method string, bits long, bpw double")
    return r.select("id", F.nullif(F.concat_ws(" · ", "method", F.concat(F.lit("declared "), F.col("bits").cast("string"), F.lit("-bit")), F.when(F.col("bpw").isNotNull(), F.concat(F.lit("effective "), F.format_string("%.2f", "bpw"), F.lit(" bpw"))), F.when(F.col("bpw") < F.col("bits") - 0.5, "mixed precision")), F.lit("")).alias("text"))


CITES = [(1, 1, "text one", None, None), (1, 2, "x", "http://u.test", "Title")]


@_q("f38_footnotes", "SELECT page, string_agg('[^' || n || ']: ' || CASE WHEN url IS NOT NULL AND title IS NOT NULL THEN '[' || title || '](' || url || ')' ELSE text END, chr(10) ORDER BY n) AS block FROM (" + values(CITES, "page", "n", "text", "url", "title") + ") GROUP BY page")
def f38(spark: SparkSession, d: str) -> DataFrame:
    r = inline(spark, CITES, "page long, n long, text string, url string, title string")
    line = F.concat(F.lit("[^"), F.col("n").cast("string"), F.lit("]: "), F.when(F.col("url").isNotNull() & F.col("title").isNotNull(), F.concat(F.lit("["), "title", F.lit("]("), "url", F.lit(")"))).otherwise(F.col("text")))
    return r.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\n").alias("block"))


COMM = [(1, "ann", 1200, True, False, "1 day ago", "hi  there\n you"), (2, None, None, False, True, None, None)]


@_q("f40_comment", "SELECT id, '**' || coalesce(author, '(anonymous)') || '**' || CASE WHEN pinned OR uploader THEN ', ' || concat_ws(' ', CASE WHEN pinned THEN '[pinned]' END, CASE WHEN uploader THEN '[uploader]' END) ELSE '' END || coalesce(', ' || format('{:,}', likes) || ' likes', '') || coalesce(', ' || ago, '') || ': ' || coalesce(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') AS line FROM (" + values(COMM, "id", "author", "likes", "pinned", "uploader", "ago", "text") + ")")
def f40(spark: SparkSession, d: str) -> DataFrame:
    r = inline(spark, COMM, "id long, author string, likes long, pinned boolean, uploader boolean, ago string, text string")
    badges = F.nullif(F.concat_ws(" ", F.when(F.col("pinned"), "[pinned]"), F.when(F.col("uploader"), "[uploader]")), F.lit(""))
    head = F.concat_ws(", ", F.concat(F.lit("**"), F.coalesce("author", F.lit("(anonymous)")), F.lit("**")), badges, F.concat(F.format_number("likes", 0), F.lit(" likes")), "ago")
    return r.select("id", F.concat(head, F.lit(": "), F.coalesce(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit(""))).alias("line"))


PROBES = [("w1", 1, 404), ("w1", 2, 200), ("w1", 3, 200), ("w2", 1, 500), ("w2", 2, 403)]


@_q("s24_best_probe", "SELECT wiki, arg_min(pos, CASE WHEN status = 200 THEN 0 WHEN status IN (401, 403) THEN 1 WHEN status >= 500 THEN 2 ELSE 3 END * 1000 + pos) AS pos FROM (" + values(PROBES, "wiki", "pos", "status") + ") GROUP BY wiki")
def s24(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("status") == 200, 0).when(F.col("status").isin(401, 403), 1).when(F.col("status") >= 500, 2).otherwise(3)
    return inline(spark, PROBES, "wiki string, pos long, status long").groupBy("wiki").agg(F.min_by("pos", F.struct(rank, "pos")).alias("pos"))


@_q("s3_size_gate", "SELECT fetch_id, max(octet_length(content)) AS bytes FROM fetch_responses WHERE status_code = 200 AND octet_length(content) <= 3000 GROUP BY fetch_id")
def s3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetch_responses").where("status_code = 200 AND octet_length(content) <= 3000").groupBy("fetch_id").agg(F.max(F.octet_length("content")).alias("bytes"))


@_q("r1_frontmatter", "SELECT * FROM (VALUES (1, E'---\\ntitle: T\\ntags:\\n  - a\\n  - b\\none: x\\n---'), (2, E'---\\ntitle: U\\nsections_not_found:\\n  - \"Foo\"\\n---')) AS t(id, text)")
def r1(spark: SparkSession, d: str) -> DataFrame:
    from sheaf.operators.render import frontmatter

    rows = spark.createDataFrame([(1, [("title", ["T"]), ("none", None), ("tags", ["a", "b"]), ("one", ["x"])], None), (2, [("title", ["U"])], ["Foo"])], "id int, fm array<struct<key:string,values:array<string>>>, lost array<string>")
    return rows.select("id", frontmatter(F.col("fm"), F.col("lost")).alias("text"))
