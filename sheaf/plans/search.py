"""Search queries over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import search as se
from sheaf.plans.fixtures import inline, values
from sheaf.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def q4_bm25_documents(spark: SparkSession, d: str) -> DataFrame:
    return se.bm25(_docs(spark, d), "doc_id", "text", ["scorecard", "distant", "verified"])


def q4_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same over a persisted index, written in two batches to the shared folder."""
    import uuid

    from sheaf.operators import index
    from sheaf.session import checkpoint_dir

    path = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    for part in (0, 1):
        index.add(_docs(spark, d).where(half == part), "doc_id", "text", path)
    return index.bm25(spark, path, ["scorecard", "distant", "verified"]).withColumnRenamed("key", "doc_id")


def q4_bm25_boosted(spark: SparkSession, d: str) -> DataFrame:
    """Body and title, the title counting twice."""
    return se.bm25(_docs(spark, d), "doc_id", "text", ["module", "distant"], boosts={"text": 1.0, "title": 2.0})


def q1_token_stats(spark: SparkSession, d: str) -> DataFrame:
    words = se.postings(_docs(spark, d).withColumn("source", F.coalesce("source", F.lit(""))).select("source", "text"), "source", "text")
    return words.groupBy("source").agg(F.count("*").alias("tokens"), F.count_distinct("term").alias("distinct_terms"))


def q5_boolean(spark: SparkSession, d: str) -> DataFrame:
    return se.matching(_docs(spark, d), "doc_id", "text", "+reviewer -scorecard distant")


def q5_grouped(spark: SparkSession, d: str) -> DataFrame:
    return se.matching(_docs(spark, d), "doc_id", "text", "(distant OR verified) AND reviewer")


def q5_phrase(spark: SparkSession, d: str) -> DataFrame:
    return se.matching(_docs(spark, d), "doc_id", "text", '"described as a"')


def q5_slop(spark: SparkSession, d: str) -> DataFrame:
    return se.matching(_docs(spark, d), "doc_id", "text", '"neither nor"~4')


def q5_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return se.matching(_docs(spark, d), "doc_id", "text", "scorecrad~2")


def q5_fuzzy_terms(spark: SparkSession, d: str) -> DataFrame:
    words = _docs(spark, d).select("doc_id", F.explode(F.array_distinct(se.terms(F.col("text")))).alias("term"))
    return words.where(F.levenshtein("term", F.lit("reader")) <= 2).groupBy("term").agg(F.count("*").alias("df"))


_REPEATS = [(1, "new new york"), (2, "new york new"), (3, "york then new"), (4, "new a b york"), (5, "new a york b times"), (6, None), (7, "york new times york")]


def q5_repeated_words(spark: SparkSession, d: str) -> DataFrame:
    """Phrases with slop over texts that repeat a word."""
    r = inline(spark, _REPEATS, "id long, v string")
    return se.matching(r, "id", "v", '"new new"~2').withColumn("q", F.lit("a")).unionByName(se.matching(r, "id", "v", '"new york times"~1').withColumn("q", F.lit("b"))).unionByName(se.matching(r, "id", "v", '"york new"~1').withColumn("q", F.lit("c")))


_MIXED = [(1, "東京タワー and 大阪"), (2, "カタカナ・テスト"), (3, "plain latin"), (4, "한국어 검색"), (5, "ภาษาไทย"), (6, None), (7, "検、索")]


def q2_unspaced_runs(spark: SparkSession, d: str) -> DataFrame:
    return inline(spark, _MIXED, "id long, v string").select("id", F.posexplode(se.unspaced_runs(F.col("v"))).alias("pos", "run"))


def q3_unspaced_match(spark: SparkSession, d: str) -> DataFrame:
    return inline(spark, _MIXED, "id long, v string").select("id", F.coalesce(se.unspaced_match(F.col("v"), "検索") | se.unspaced_match(F.col("v"), "タワー"), F.lit(False)).alias("matched"))


def q3_japanese(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(se.unspaced_match(F.col("text"), "注釈")).select("doc_id")


def q6_outcome(spark: SparkSession, d: str) -> DataFrame:
    """hits, none or unavailable for each document, whose slices fail on a line beyond all bounds."""
    text = F.col("text")
    failed = F.exists(F.split(text, "\n"), lambda x: F.length(x) > 2000)
    hit = F.array_contains(se.terms(text), "reviewer")
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", F.when(failed, "unavailable").when(hit, "hits").otherwise("none").alias("outcome"))


_SNIPS = [(1, "p1", "s1", "a"), (2, "p1", "s2", "b"), (3, "p2", "s1", "c"), (4, "p1", "s1", "d"), (5, "p2", None, "e")]


def q12_grouped_snippets(spark: SparkSession, d: str) -> DataFrame:
    rows = inline(spark, _SNIPS, "pos long, paper string, section string, snip string")
    g = rows.groupBy("paper", F.coalesce("section", F.lit("")).alias("section")).agg(F.min("pos").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "snip"))), lambda x: x["snip"]), ",").alias("snips"))
    return g


QUERIES = {f.__name__: f for f in (q4_bm25_documents, q4_indexed, q4_bm25_boosted, q1_token_stats, q5_boolean, q5_grouped, q5_phrase, q5_slop, q5_repeated_words, q5_fuzzy, q5_fuzzy_terms, q2_unspaced_runs, q3_unspaced_match, q3_japanese, q6_outcome, q12_grouped_snippets)}

_W = "(SELECT doc_id, coalesce(source, '') AS source, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'), lambda x: strlen(x) < 40) AS w FROM documents)"


def _bm25_sql(parts: list[tuple[str, float]], query: list[str]) -> str:
    one = []
    for field, boost in parts:
        w = f"(SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce({field}, '')), '[\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) < 40) AS w FROM documents)"
        tf = "SELECT doc_id, CAST(len(w) AS DOUBLE) AS l, " + ", ".join(f"CAST(len(list_filter(w, lambda x: x = '{q}')) AS DOUBLE) AS t{i}" for i, q in enumerate(query)) + f" FROM {w}"
        st = "SELECT CAST(count(*) AS DOUBLE) AS n, avg(l) AS a, " + ", ".join(f"CAST(sum(CAST(t{i} > 0 AS INT)) AS DOUBLE) AS d{i}" for i in range(len(query))) + f" FROM ({tf})"
        score = " + ".join(f"{boost} * ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (1 - 0.75 + 0.75 * l / a))" for i in range(len(query)))
        one.append(f"SELECT doc_id, {score} AS s FROM ({tf}), ({st}) WHERE " + " OR ".join(f"t{i} > 0" for i in range(len(query))))
    return "SELECT doc_id, round(sum(s), 6) AS score FROM (" + " UNION ALL ".join(one) + ") GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 50"


_RUN = "[\\x{3041}-\\x{309F}\\x{30A1}-\\x{30FA}\\x{30FC}-\\x{30FF}\\x{31F0}-\\x{31FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{FF66}-\\x{FF9F}\\x{1100}-\\x{11FF}\\x{3130}-\\x{318F}\\x{AC00}-\\x{D7A3}\\x{0E01}-\\x{0E3A}\\x{0E40}-\\x{0E4E}]+"
_MV = "(" + values(_MIXED, "id", "v") + ")"
SQL = {
    "q4_bm25_documents": _bm25_sql([("text", 1.0)], ["scorecard", "distant", "verified"]),
    "q4_indexed": _bm25_sql([("text", 1.0)], ["scorecard", "distant", "verified"]),
    "q4_bm25_boosted": _bm25_sql([("text", 1.0), ("title", 2.0)], ["module", "distant"]),
    "q1_token_stats": f"SELECT source, count(*) AS tokens, count(DISTINCT t) AS distinct_terms FROM (SELECT source, unnest(w) AS t FROM {_W}) GROUP BY source",
    "q5_boolean": f"SELECT doc_id FROM {_W} WHERE list_contains(w, 'reviewer') AND NOT list_contains(w, 'scorecard')",
    "q5_grouped": f"SELECT doc_id FROM {_W} WHERE (list_contains(w, 'distant') OR list_contains(w, 'verified')) AND list_contains(w, 'reviewer')",
    "q5_phrase": f"SELECT doc_id FROM {_W} WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' described as a ')",
    "q5_slop": f"SELECT DISTINCT a.doc_id FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM {_W}) a JOIN (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM {_W}) b ON a.doc_id = b.doc_id AND a.t = 'neither' AND b.t = 'nor' AND b.i BETWEEN a.i AND a.i + 5",
    "q5_repeated_words": "WITH p AS (SELECT id, unnest(string_split(v, ' ')) AS t, generate_subscripts(string_split(v, ' '), 1) AS i FROM (" + values(_REPEATS, "id", "v") + ") WHERE v IS NOT NULL) SELECT DISTINCT a.id, 'a' AS q FROM p a JOIN p b ON a.id = b.id AND a.t = 'new' AND b.t = 'new' AND b.i BETWEEN a.i + 1 AND a.i + 3 UNION ALL SELECT DISTINCT a.id, 'b' FROM p a JOIN p b ON a.id = b.id AND a.t = 'new' AND b.t = 'york' AND b.i > a.i JOIN p c ON c.id = b.id AND c.t = 'times' AND c.i > b.i AND c.i - a.i <= 3 UNION ALL SELECT DISTINCT a.id, 'c' FROM p a JOIN p b ON a.id = b.id AND a.t = 'york' AND b.t = 'new' AND b.i BETWEEN a.i + 1 AND a.i + 2",
    "q5_fuzzy": f"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(w) AS t FROM {_W}) WHERE levenshtein(t, 'scorecrad') <= 2",
    "q5_fuzzy_terms": f"SELECT t AS term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(w) AS t FROM {_W}) WHERE levenshtein(t, 'reader') <= 2 GROUP BY t",
    "q2_unspaced_runs": f"SELECT id, generate_subscripts(r, 1) - 1 AS pos, unnest(r) AS run FROM (SELECT id, regexp_extract_all(v, '{_RUN}') AS r FROM {_MV})",
    "q3_unspaced_match": f"SELECT id, coalesce(len(list_filter(regexp_extract_all(v, '{_RUN}'), lambda r: contains(r, '検索') OR contains(r, 'タワー'))) > 0, false) AS matched FROM {_MV}",
    "q3_japanese": "SELECT doc_id FROM documents WHERE contains(text, '注釈')",
    "q6_outcome": f"SELECT d.doc_id, CASE WHEN len(list_filter(string_split(d.text, chr(10)), lambda x: length(x) > 2000)) > 0 THEN 'unavailable' WHEN list_contains(w, 'reviewer') THEN 'hits' ELSE 'none' END AS outcome FROM documents d JOIN {_W} w ON w.doc_id = d.doc_id WHERE d.text IS NOT NULL",
    "q12_grouped_snippets": "SELECT paper, coalesce(section, '') AS section, min(pos) AS first, string_agg(snip, ',' ORDER BY pos) AS snips FROM (" + values(_SNIPS, "pos", "paper", "section", "snip") + ") GROUP BY 1, 2",
}
