"""Code definitions, wiki pages and metadata documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import code, documents, wiki
from sheaf.operators.metadata import update_notices
from sheaf.plans.fixtures import inline, values
from sheaf.plans.metadata import _NT, NOTES
from sheaf.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _q(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").dropDuplicates(["file_id"])


_EXT = r"\.([A-Za-z]+)$"


@_q("x18_definitions")
def x18(spark: SparkSession, d: str) -> DataFrame:
    return code.code_definitions(_files(spark, d), "file_id", F.regexp_extract("path", _EXT, 1), "source")


@_q("x19_listing", "SELECT file_id, start_line, name, repeat('  ', CAST(depth AS BIGINT)) || '- ' || kind || ' ' || name || ' (L' || start_line || '-' || end_line || ')' || CASE WHEN docstring <> '' THEN ' — ' || docstring ELSE '' END AS line FROM (SELECT DISTINCT * FROM code_definitions)")
def x19(spark: SparkSession, d: str) -> DataFrame:
    return code.listing(table(spark, d, "code_definitions").distinct()).select("file_id", "start_line", "name", "line")


@_q("x17_code_slices")
def x17(spark: SparkSession, d: str) -> DataFrame:
    import pyarrow as pa

    schema = pa.schema([("key", pa.int64()), ("idx", pa.int32()), ("off", pa.int32()), ("text", pa.string())])
    return _files(spark, d).select("file_id", F.regexp_extract("path", _EXT, 1).alias("ext"), "source").mapInArrow(code._rows(lambda s, e: code.code_slices(s, e), schema), "file_id long, idx int, off int, text string").select("file_id", "idx", "off", F.length("text").alias("n"))


@_q("h17_banner", f"SELECT doi, '> **' || CASE class WHEN 'retraction' THEN '[RETRACTED]' WHEN 'expression_of_concern' THEN '[EXPRESSION OF CONCERN]' ELSE '[CORRECTED]' END || '** ' || concat_ws(' ', CASE class WHEN 'retraction' THEN 'This paper has been retracted' WHEN 'expression_of_concern' THEN 'The validity of this paper has been called into question' ELSE 'This paper has been corrected' END, 'on ' || date, '— notice: https://doi.org/' || notice_doi) || '.' AS banner FROM {_NT}")
def h17(spark: SparkSession, d: str) -> DataFrame:
    return documents.banner(update_notices(inline(spark, NOTES, "doi string, pos long, kind string, notice_doi string, date string"))).select("doi", "banner")


@_q("h15_error_text", "SELECT doc_id, CASE WHEN t = '' THEN 'Error: HTTP 403 for ' || url ELSE 'Error: HTTP 403 for ' || url || E'\\n\\nThe server returned an error page:\\n\\n' || CASE WHEN length(t) > 600 THEN rtrim(left(t, 600)) || ' …' ELSE t END END AS text FROM (SELECT doc_id, coalesce(url, '?') AS url, trim(coalesce(title, '')) AS t FROM documents)")
def h15(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", documents.error_text(F.coalesce("url", F.lit("?")), F.lit(403), F.col("title")).alias("text"))


ADV = [("A-1", "Bad parse", "CVE-1, CVE-2", 9.8, "http://o.test"), ("A-2", "", None, None, ""), ("A-3", "x", "CVE-3", 0.0, None)]


@_q("g7_advisory", "SELECT id, concat_ws(chr(10), '# ' || id || chr(10), '**Title:** ' || nullif(title, ''), '**CVEs:** ' || nullif(aliases, ''), '**CVSS:** ' || CAST(score AS VARCHAR) || ' (' || CASE WHEN score >= 9 THEN 'Critical' WHEN score >= 7 THEN 'High' WHEN score >= 4 THEN 'Medium' WHEN score > 0 THEN 'Low' ELSE 'None' END || ')', '**OSV:** ' || nullif(url, '')) AS text FROM (" + values(ADV, "id", "title", "aliases", "score", "url") + ")")
def g7(spark: SparkSession, d: str) -> DataFrame:
    return documents.advisory(inline(spark, ADV, "id string, title string, aliases string, score double, url string"))


@_q("g7_version_table", "SELECT package, E'## Recent Versions\\n\\n| Version | Published | Deprecated |\\n|---------|-----------|------------|\\n' || string_agg('| ' || version || ' | ' || coalesce(left(published, 10), '') || ' |  |', chr(10) ORDER BY k) || CASE WHEN max(total) > 3 THEN E'\\n\\n*3 of ' || max(total) || ' versions shown.*' ELSE '' END AS text FROM (SELECT o_custkey AS package, CAST(o_orderkey AS VARCHAR) AS version, CAST(o_orderdate AS VARCHAR) AS published, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS VARCHAR) DESC NULLS LAST, CAST(o_orderkey AS VARCHAR) DESC) AS k, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders) WHERE k <= 3 GROUP BY package")
def g7v(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("package"), F.col("o_orderkey").cast("string").alias("version"), F.col("o_orderdate").cast("string").alias("published"), F.lit(False).alias("deprecated"))
    return documents.version_table(o, 3)


_CR = "(SELECT record_id, any_value(doi) AS doi, any_value(title) AS title, any_value(year) AS year FROM citation_records GROUP BY record_id)"


@_q("g9_enriched", f"WITH r AS (SELECT doi, min(record_id) AS record_id, count(*) AS n FROM {_CR} WHERE doi IS NOT NULL GROUP BY doi), b AS (SELECT * FROM {_CR}) SELECT b.record_id, coalesce(b.title, 'Untitled') AS title, r.n AS citations FROM b LEFT JOIN r ON r.doi = b.doi")
def g9(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "citation_records").dropDuplicates(["record_id"]).select("record_id", "doi", "title")
    per = one.where("doi IS NOT NULL").groupBy("doi").agg(F.count("*").alias("citations"))
    registry = one.where("doi IS NOT NULL").groupBy("doi").agg(F.lit(None).cast("string").alias("registry_title"))
    return documents.enriched_papers(one, per, registry).select("record_id", "title", "citations")


@_q("a21_quant_verdict", "SELECT * FROM (VALUES (1, true, 'affine', 'packed storage elements', CAST(NULL AS DOUBLE)), (2, false, NULL, NULL, 16.0), (3, true, 'FP8-native (E4M3)', NULL, 8.0), (4, true, NULL, 'more than double the declared width', NULL), (5, false, NULL, 'no parameter count', NULL)) AS t(id, is_quant, native, reason, bpw)")
def a21(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, {"U32": 90, "BF16": 10}, None, [], None, 100, 50), (2, {"BF16": 100}, None, ["text"], None, 100, 200), (3, {"F8_E4M3": 90, "BF16": 10}, "quantized", [], None, 100, 100), (4, {"BF16": 100}, None, ["4-bit"], 4, 100, 150), (5, {}, None, [], None, None, 5)]
    df = spark.createDataFrame(rows, "id int, dtypes map<string,bigint>, relation string, tags array<string>, bits int, total bigint, bytes bigint")
    return documents.quant_verdict(df).select("id", "is_quant", "native", "reason", "bpw")


MSGS = [(1, "ERROR: Sign in to confirm you're not a bot"), (2, "Private video. Sign in"), (3, "This video is age restricted"), (4, "Video unavailable"), (5, "odd"), (6, None), (7, "Join: members-only content")]


@_q("p5e_error_kinds", "SELECT id, CASE WHEN v IS NULL THEN NULL WHEN regexp_matches(lower(v), 'sign in to confirm you|confirm you''re not a bot') THEN 'bot check' WHEN contains(lower(v), 'private video') THEN 'private' WHEN regexp_matches(lower(v), 'members-only|members only') THEN 'members only' WHEN regexp_matches(lower(v), 'age.*restrict|restrict.*age|confirm your age') THEN 'age-restricted' WHEN regexp_matches(lower(v), 'video unavailable|this video is not available') THEN 'unavailable' ELSE 'failed' END AS kind FROM (" + values(MSGS, "id", "v") + ")")
def p5(spark: SparkSession, d: str) -> DataFrame:
    return inline(spark, MSGS, "id long, v string").select("id", documents.error_kind(F.col("v")).alias("kind"))


QUERIES["error_kinds"], SQL["error_kinds"] = QUERIES.pop("p5e_error_kinds"), SQL.pop("p5e_error_kinds")

IDS = [(1, "org/name"), (2, "/bad"), (3, "a b"), (4, "org/na me"), (5, None)]


@_q("f17_safe_ids", "SELECT id, CASE WHEN regexp_matches(v, '^[A-Za-z0-9][\\w.-]{0,95}/[\\w.-]{1,96}$') THEN v END AS repo, CASE WHEN regexp_matches(v, '^[A-Za-z0-9][\\w.-]{0,63}$') THEN v END AS ident FROM (" + values(IDS, "id", "v") + ")")
def f17(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    return inline(spark, IDS, "id long, v string").select("id", F.when(v.rlike(r"^[A-Za-z0-9][\w.-]{0,95}/[\w.-]{1,96}$"), v).alias("repo"), F.when(v.rlike(r"^[A-Za-z0-9][\w.-]{0,63}$"), v).alias("ident"))


WIKI = """<div id="toc">toc</div><p>As <a href="#CITEREFFoo2005">Foo (2005)</a> says<sup class="reference">[1]</sup> and <math alttext="x"><annotation encoding="application/x-tex">x^2</annotation></math>.</p><h2>Next<span class="mw-editsection">[edit]</span></h2><table class="navbox"><tr><td>links</td></tr></table><div class="mw-references-wrap"><ol class="references"><li><span class="reference-text">Foo 2005, <a href="#CITEREFFoo2005">p. 1</a></span></li><li><span class="reference-text"><a class="external" href="http://b.test">Bar</a> site</span></li></ol></div><ul><li><cite id="CITEREFFoo2005">Foo, F.</cite> <a class="external" href="http://f.test">Book</a></li></ul>"""


@_q("f41_footnotes", "SELECT * FROM (VALUES (1, 'Foo 2005, p. 1', NULL, 'Foo, F. Book'), (2, 'Bar site', 'http://b.test', '')) AS t(n, text, url, sources)")
def f41(spark: SparkSession, d: str) -> DataFrame:
    """Footnotes of wiki pages; the page is parsed in one Arrow UDF."""
    import pandas as pd

    fn = F.pandas_udf(lambda s: pd.Series([[(x["n"], x["text"], x["url"], " ; ".join(x["sources"])) for x in wiki.footnotes(p)] for p in s]), "array<struct<n:int,text:string,url:string,sources:string>>")
    return spark.createDataFrame([(WIKI,)], "page string").select(F.explode(fn("page")).alias("f")).select("f.*")


@_q("f41_author_dates", "SELECT * FROM (VALUES ('CITEREFFoo2005', 'Foo (2005)', 'Foo, F. Book', 'http://f.test')) AS t(key, shorthand, text, url)")
def f41a(spark: SparkSession, d: str) -> DataFrame:
    import pandas as pd

    fn = F.pandas_udf(lambda s: pd.Series([[(x["key"], x["shorthand"], x["text"], x["url"]) for x in wiki.author_date_citations(p)] for p in s]), "array<struct<key:string,shorthand:string,text:string,url:string>>")
    return spark.createDataFrame([(WIKI,)], "page string").select(F.explode(fn("page")).alias("f")).select("f.*")


RAWH = [(1, "<h2><div>One</div><p>Two</p></h2><div>x</div>"), (2, "<h3>Plain</h3>"), (3, None)]


@_q("h6_heading_blocks")
def h6(spark: SparkSession, d: str) -> DataFrame:
    from sheaf.operators.html import flatten_heading_blocks

    return inline(spark, RAWH, "id long, v string").select("id", flatten_heading_blocks(F.col("v")).alias("v"))


LABELS = [(1, "a\u0007b"), (2, "plain"), (3, None), (4, "x\u200by")]


@_q("h18_labels", "SELECT id, regexp_replace(v, '\\p{C}', ' ', 'g') AS label FROM (" + values(LABELS, "id", "v") + ")")
def h18(spark: SparkSession, d: str) -> DataFrame:
    from sheaf.functions.text import label

    return inline(spark, LABELS, "id long, v string").select("id", label(F.col("v")).alias("label"))


@_q("s5_charsets", "SELECT fetch_id, coalesce(nullif(lower(regexp_extract(ct, '(?i)charset\\s*=\\s*[\"'']?([\\w.:-]+)', 1)), ''), 'utf-8') AS charset FROM (SELECT fetch_id, any_value(headers['content-type']) AS ct FROM fetch_responses GROUP BY fetch_id)")
def s5(spark: SparkSession, d: str) -> DataFrame:
    from sheaf.functions.text import charset

    r = table(spark, d, "fetch_responses").dropDuplicates(["fetch_id"])
    return r.select("fetch_id", charset(F.try_element_at("headers", F.lit("content-type"))).alias("charset"))


@_q("s5_decoded")
def s5d(spark: SparkSession, d: str) -> DataFrame:
    from sheaf.functions.text import decoded

    r = table(spark, d, "fetch_responses").dropDuplicates(["fetch_id"])
    return r.select("fetch_id", F.length(decoded(F.col("content"), F.try_element_at("headers", F.lit("content-type")))).alias("chars"))


@_q("q9_requested_windows", "WITH w AS (SELECT DISTINCT video_id, win_idx FROM windows), q AS (SELECT video_id, unnest([3, 0, 3, 999]) AS win_idx, unnest([0, 1, 2, 3]) AS pos FROM (SELECT DISTINCT video_id FROM windows)) SELECT q.video_id, q.win_idx, min(pos) AS pos, w.win_idx IS NULL AS missing FROM q LEFT JOIN w USING (video_id, win_idx) GROUP BY q.video_id, q.win_idx, w.win_idx IS NULL")
def q9(spark: SparkSession, d: str) -> DataFrame:
    """Windows 3, 0, 3 and 999 of each video in the order asked, each once, those that are not there marked."""
    w = table(spark, d, "windows").select("video_id", "win_idx").distinct().withColumn("there", F.lit(True))
    ask = w.select("video_id").distinct().select("video_id", F.posexplode(F.array(*map(F.lit, (3, 0, 3, 999)))).alias("pos", "win_idx"))
    first = ask.groupBy("video_id", "win_idx").agg(F.min("pos").alias("pos"))
    return first.join(w, ["video_id", "win_idx"], "left").select("video_id", "win_idx", "pos", F.col("there").isNull().alias("missing"))


FORUM = [(1, 1, None, "ann", 10), (1, 2, 1, "bob", 20), (1, 3, 2, "cy", 5), (1, 4, 99, "lost", 1), (1, 5, None, "di", 7), (2, 1, None, "ed", 3)]


@_q("g3_forum_tree", "SELECT * FROM (VALUES (1, 1, '- #1 — @ann (10 chars)'), (1, 2, '  - #2 — @bob (reply to #1, 20 chars)'), (1, 3, '    - #3 — @cy (reply to #2, 5 chars)'), (1, 5, '- #5 — @di (7 chars)'), (2, 1, '- #1 — @ed (3 chars)')) AS t(topic, post, line)")
def g3(spark: SparkSession, d: str) -> DataFrame:
    """A topic's posts by what they answer; answers to posts that are not there vanish."""
    from sheaf.operators.threads import thread_tree

    p = inline(spark, FORUM, "topic long, post long, reply long, user string, chars long")
    t = thread_tree(p, "topic", "post", "reply").join(p, ["topic", "post"])
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- #"), F.col("post").cast("string"), F.lit(" — @"), "user", F.lit(" ("), F.when(F.col("reply").isNotNull(), F.concat(F.lit("reply to #"), F.col("reply").cast("string"), F.lit(", "))).otherwise(""), F.col("chars").cast("string"), F.lit(" chars)"))
    return t.select("topic", "post", line.alias("line"))


STORE = [("10.1/a", 1, False, None), ("10.1/b", None, False, "old"), ("10.1/c", 3, True, None)]
COMMANDS = [(1, "10.1/a", "score", "4"), (2, "10.1/b", "note", "new"), (3, "10.1/a", "score", "5"), (4, "10.1/c", "remove", None), (5, "10.1/b", "confirm", None), (6, "10.1/zz", "score", "1")]


@_q("e4_commands", "SELECT * FROM (VALUES ('10.1/a', 5, false, NULL), ('10.1/b', NULL, true, 'new')) AS t(doi, score, confirmed, notes)")
def e4(spark: SparkSession, d: str) -> DataFrame:
    from sheaf.operators.shelf import apply_commands

    return apply_commands(inline(spark, STORE, "doi string, score int, confirmed boolean, notes string"), inline(spark, COMMANDS, "pos long, doi string, action string, value string"))
