"""Threads, the citation store, caches and ledgers, pages as Markdown, payload sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import html as hm
from sheaf.operators import shelf as sh
from sheaf.operators import state as ss
from sheaf.operators.threads import thread_tree
from sheaf.plans.fixtures import inline, values
from sheaf.sources import payloads as pl
from sheaf.sources.tables import table


def _thread(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as a thread: each answers the event of half its place."""
    from pyspark.sql import Window

    e = table(spark, d, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("k"))
    return e.select("user_id", F.col("k").cast("long"), F.when(F.col("k") > 1, F.floor(F.col("k") / 2)).alias("parent"))


_EV = "(SELECT user_id, k, CASE WHEN k > 1 THEN k // 2 END AS parent FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events))"
_TREE = f"WITH RECURSIVE r AS (SELECT user_id, k, 0 AS depth, lpad(CAST(k AS VARCHAR), 20, '0') AS path FROM {_EV} WHERE parent IS NULL UNION ALL SELECT e.user_id, e.k, r.depth + 1, r.path || '/' || lpad(CAST(e.k AS VARCHAR), 20, '0') FROM r JOIN {_EV} e ON e.user_id = r.user_id AND e.parent = r.k WHERE r.depth + 1 < 6)"


def g1_thread_tree(spark: SparkSession, d: str) -> DataFrame:
    return thread_tree(_thread(spark, d), "user_id", "k", "parent").select("user_id", "k", "depth", "path")


def g2_thread_outline(spark: SparkSession, d: str) -> DataFrame:
    t = thread_tree(_thread(spark, d), "user_id", "k", "parent")
    return t.select("user_id", "k", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- #"), F.col("k").cast("string")).alias("line"), F.concat(F.repeat(F.lit("#"), F.least(F.col("depth") + 3, F.lit(6))), F.lit(" "), F.col("k").cast("string")).alias("heading"))


def j10_parents(spark: SparkSession, d: str) -> DataFrame:
    t = _thread(spark, d)
    replies = t.groupBy("user_id", F.col("parent").alias("k")).agg(F.count("*").alias("replies"))
    return t.where("parent IS NULL").join(replies, ["user_id", "k"], "left").select("user_id", "k", F.coalesce("replies", F.lit(0)).alias("replies"))


KINDS = [(1, "t3", "Title", None, 5), (2, "t1", None, "a  comment", 2), (3, "t5", "place", None, None), (4, "t2", "person", None, None), (5, "t9", "x", None, None)]


def g4_listing(spark: SparkSession, d: str) -> DataFrame:
    r = inline(spark, KINDS, "id long, kind string, title string, body string, score long")
    line = F.when(F.col("kind") == "t3", F.concat(F.lit("post: "), "title")).when(F.col("kind") == "t1", F.concat(F.lit("comment: "), F.regexp_replace("body", r"\s+", " "))).when(F.col("kind") == "t5", F.concat(F.lit("community: "), "title")).when(F.col("kind") == "t2", F.concat(F.lit("user: "), "title"))
    return r.select("id", line.alias("line")).where("line IS NOT NULL")


def e1_shelf(spark: SparkSession, d: str) -> DataFrame:
    f = sh.fold_shelf(table(spark, d, "citation_records"))
    return f.select("doi", F.array_join("alt_dois", ",").alias("alt_dois"), "retracted", "score")


def e3_resolve(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "citation_records")
    store = sh.fold_shelf(r)
    wanted = r.select(F.explode(F.coalesce("alt_dois", F.array().cast("array<string>"))).alias("doi")).where("doi IS NOT NULL").distinct()
    return sh.resolve(wanted, store)


def _one(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "citation_records").dropDuplicates(["record_id"])


def k1_bibtex(spark: SparkSession, d: str) -> DataFrame:
    return sh.bibtex(_one(spark, d)).select("record_id", "entry")


def k2_ris(spark: SparkSession, d: str) -> DataFrame:
    return sh.ris(_one(spark, d)).select("record_id", "entry")


def k3_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records through JSON and back with a fixed schema, which drops what it does not know."""
    r = _one(spark, d).select("record_id", "doi", "title", "year")
    text = r.select("record_id", F.to_json(F.struct("doi", "title", "year", F.lit(1).alias("unknown"))).alias("j"))
    return text.select("record_id", F.from_json("j", "doi string, title string, year int").alias("v")).select("record_id", "v.*")


def e5_listing(spark: SparkSession, d: str) -> DataFrame:
    return sh.listing(_one(spark, d)).select("record_id", "line")


def m1_cache_trace(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return ss.cache_trace(e, "user_id", "event_type", ["event_id"], most=3).select("user_id", "event_id", "hit", "evicted")


def m4_lru_trace(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return ss.cache_trace(e, "user_id", "event_type", ["event_id"], most=4, promote=False).select("user_id", "event_id", "hit")


def m5_limiter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    return ss.granted(e, "user_id", F.col("s"), ["ts", "event_id"], 3_600_000_000).select("event_id", F.col("granted").cast("long").alias("granted"))


def m6_fire_once(spark: SparkSession, d: str) -> DataFrame:
    return ss.fires(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "fires")


def m7_seen_before(spark: SparkSession, d: str) -> DataFrame:
    """Events of a kind after the user's first purchase."""
    e = table(spark, d, "events")
    first = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("first"))
    return e.join(first, "user_id").where("ts > first").select("event_id")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "fetch_responses").where("status_code = 200 AND content IS NOT NULL").dropDuplicates(["fetch_id"])
    return r.withColumn("html", F.try_validate_utf8(F.col("content").cast("string"))).where("html IS NOT NULL AND html LIKE '%<html%'")


def h1_markdown(spark: SparkSession, d: str) -> DataFrame:
    return hm.markdown_pages(_pages(spark, d), "fetch_id", F.col("html")).select("fetch_id", "title", F.length("markdown").alias("n"))


def h3_titles(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    h1 = F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return p.select("fetch_id", F.coalesce(F.nullif(F.trim(h1), F.lit("")), F.nullif(F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)), F.lit("")), F.lit("Untitled")).alias("title"))


RAW = [(1, "<pre>a\nb</pre><pre><code>c</code></pre>"), (2, '<a href="x>y"><h2 id="q">T</h2></a> <a href="z">w</a>'), (3, "<h2><div>One</div><div>Two</div></h2>"), (4, None)]


def h4_pre(spark: SparkSession, d: str) -> DataFrame:
    return inline(spark, RAW, "id long, v string").select("id", hm.wrap_bare_pre(F.col("v")).alias("v"))


def h5_anchors(spark: SparkSession, d: str) -> DataFrame:
    return inline(spark, RAW, "id long, v string").select("id", hm.unwrap_heading_anchors(F.col("v")).alias("v"))


EVENTS3 = [("v", '{"events":[{"tStartMs":1000,"dDurationMs":2500,"segs":[{"utf8":"hel"},{"utf8":"lo "}]},{"tStartMs":4000},{"tStartMs":5000,"segs":[{"utf8":"  "}]},{"tStartMs":6000,"segs":[{"utf8":"x"}]}]}')]


def s17_timed_text(spark: SparkSession, d: str) -> DataFrame:
    return pl.timed_text(inline(spark, EVENTS3, "video string, body string"), "video", "body")


WIKI = [("w", '{"query":{"searchinfo":{"totalhits":2},"search":[{"title":"A","pageid":1,"snippet":"x <span class=\\"searchmatch\\">y</span>"},{"title":"B","pageid":2,"snippet":"z"}]}}'), ("f", '{"query":{"search":[{"title":"C","pageid":3,"snippet":""}]}}')]


def s7_wiki_search(spark: SparkSession, d: str) -> DataFrame:
    return pl.wiki_search(inline(spark, WIKI, "wiki string, body string"), "wiki", "body")


QUERIES = {f.__name__: f for f in (g1_thread_tree, g2_thread_outline, j10_parents, g4_listing, e1_shelf, e3_resolve, e5_listing, k1_bibtex, k2_ris, k3_round_trip, m1_cache_trace, m4_lru_trace, m5_limiter, m6_fire_once, m7_seen_before, h1_markdown, h3_titles, h4_pre, h5_anchors, s17_timed_text, s7_wiki_search)}
_CR = "(SELECT record_id, any_value(doi) AS doi, any_value(title) AS title, any_value(authors) AS authors, any_value(year) AS year, any_value(venue) AS venue, any_value(bibtex) AS bibtex, any_value(score) AS score, any_value(confirmed) AS confirmed, any_value(source_tool) AS source_tool FROM citation_records GROUP BY record_id)"
_ESC = "replace(replace(replace(replace({0}, '&', '\\&'), '%', '\\%'), '#', '\\#'), '_', '\\_')"
_FIRST = "authors[1]"
_KEY = f"coalesce(lower(regexp_replace(CASE WHEN contains({_FIRST}, ',') THEN string_split({_FIRST}, ',')[1] ELSE list_last(regexp_split_to_array(trim({_FIRST}), '\\s+')) END, '[^a-zA-Z]', '', 'g')), 'unknown') || coalesce(CAST(CAST(nullif(year, 0) AS INT) AS VARCHAR), 'nd')"
SQL = {
    "g1_thread_tree": f"{_TREE} SELECT user_id, k, depth, path FROM r",
    "g2_thread_outline": f"{_TREE} SELECT user_id, k, repeat('  ', depth) || '- #' || k AS line, repeat('#', least(depth + 3, 6)) || ' ' || k AS heading FROM r",
    "j10_parents": f"SELECT t.user_id, t.k, count(r.k) AS replies FROM {_EV} t LEFT JOIN {_EV} r ON r.user_id = t.user_id AND r.parent = t.k WHERE t.parent IS NULL GROUP BY t.user_id, t.k",
    "g4_listing": "SELECT id, CASE kind WHEN 't3' THEN 'post: ' || title WHEN 't1' THEN 'comment: ' || regexp_replace(body, '\\s+', ' ', 'g') WHEN 't5' THEN 'community: ' || title ELSE 'user: ' || title END AS line FROM (" + values(KINDS, "id", "kind", "title", "body", "score") + ") WHERE kind IN ('t1', 't2', 't3', 't5')",
    "k1_bibtex": f"SELECT record_id, coalesce(nullif(trim(bibtex), ''), '@misc{{' || {_KEY} || E',\\n' || concat_ws(E',\\n', CASE WHEN len(authors) > 0 THEN '  author = {{' || {_ESC.format(chr(39).join(['array_to_string(authors, ', ' and ', ')']))} || '}}' END, '  title = {{' || {_ESC.format('coalesce(title, ' + chr(39) * 2 + ')')} || '}}', CASE WHEN year > 0 THEN '  year = {{' || CAST(CAST(year AS INT) AS VARCHAR) || '}}' END, CASE WHEN venue <> '' THEN '  journal = {{' || {_ESC.format('venue')} || '}}' END, CASE WHEN doi <> '' THEN '  doi = {{' || doi || '}}' END, CASE WHEN regexp_extract(doi, '^10\\.48550/arXiv\\.(.+)$', 1) <> '' THEN '  eprint = {{' || regexp_extract(doi, '^10\\.48550/arXiv\\.(.+)$', 1) || E'}},\\n  archivePrefix = {{arXiv}}' END) || E'\\n}}') AS entry FROM {_CR}",
    "k2_ris": f"SELECT record_id, concat_ws(chr(10), 'TY  - GEN', nullif(array_to_string(list_transform(authors, lambda a: 'AU  - ' || a), chr(10)), ''), 'TI  - ' || coalesce(title, ''), CASE WHEN venue <> '' THEN 'JO  - ' || venue END, CASE WHEN year > 0 THEN 'PY  - ' || CAST(CAST(year AS INT) AS VARCHAR) END, CASE WHEN doi <> '' THEN 'DO  - ' || doi END, 'ER  - ') AS entry FROM {_CR}",
    "k3_round_trip": f"SELECT record_id, doi, title, year FROM {_CR}",
    "e5_listing": f"SELECT record_id, '| ' || coalesce(CAST(CAST(score AS INT) AS VARCHAR), '—') || ' | ' || CASE WHEN confirmed THEN 'confirmed' ELSE '' END || ' | ' || CASE WHEN length(title) > 50 THEN left(title, 50) || '...' ELSE coalesce(title, '') END || ' | ' || coalesce(doi, '—') || ' | ' || coalesce(source_tool, '—') || ' |' AS line FROM {_CR}",
    "m5_limiter": "SELECT event_id, n * 3600000000 + max(t - n * 3600000000) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS granted FROM (SELECT event_id, user_id, epoch_us(CAST(ts AS TIMESTAMP)) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)",
    "m6_fire_once": "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS fires FROM events",
    "m7_seen_before": "SELECT event_id FROM events e JOIN (SELECT user_id, min(ts) AS first FROM events WHERE event_type = 'purchase' GROUP BY user_id) f USING (user_id) WHERE e.ts > f.first",
    "h3_titles": "SELECT fetch_id, coalesce(nullif(trim(regexp_extract(h, '(?is)<h1[^>]*>(.*?)</h1>', 1)), ''), nullif(trim(regexp_extract(h, '(?is)<title>(.*?)</title>', 1)), ''), 'Untitled') AS title FROM (SELECT fetch_id, any_value(TRY(decode(content))) AS h FROM fetch_responses WHERE status_code = 200 AND content IS NOT NULL GROUP BY fetch_id) WHERE h LIKE '%<html%'",
    "s17_timed_text": "SELECT * FROM (VALUES ('v', 0, CAST(1.0 AS DOUBLE), CAST(2.5 AS DOUBLE), 'hello'), ('v', 3, CAST(6.0 AS DOUBLE), CAST(0.0 AS DOUBLE), 'x')) AS t(video, pos, start, duration, text)",
    "s7_wiki_search": "SELECT * FROM (VALUES ('w', 2, 0, 'A', 1, 'x **y**'), ('w', 2, 1, 'B', 2, 'z'), ('f', NULL, 0, 'C', 3, '')) AS t(wiki, total, pos, title, pageid, snippet)",
}
