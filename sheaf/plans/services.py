"""Payloads of services, and documents made of rows. The SQL reads the same payloads or tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import reports as rp
from sheaf.operators import structure as st
from sheaf.plans.fixtures import inline, values
from sheaf.plans.structure import _PACK, _PARENT
from sheaf.plans.timed import _AWARE, _CHAP, _MMSS, _WIN, _chapters, _segments, _windows
from sheaf.sources import services as sv
from sheaf.sources.tables import latest, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _q(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _bodies(*rows: tuple) -> list[tuple]:
    return [(k, b if isinstance(b, str) or b is None else json.dumps(b, ensure_ascii=False)) for k, b in rows]


def _payload(rows: list[tuple]):
    return lambda spark: inline(spark, rows, "k string, body string"), "(" + values(rows, "k", "body") + ")"


def _each(source: str, path: str, alias: str = "e", more: str = "") -> str:
    """Rows of a JSON array with their places."""
    return f"(SELECT k, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS {alias}{more} FROM (SELECT k, body, from_json(json_extract(body, '{path}'), '[\"JSON\"]') AS l FROM {source} WHERE json_valid(body)))"


CSL, _CSL = _payload(_bodies(
    ("a", {"DOI": "10.1/AbC", "title": "On rivers", "author": [{"family": "Sato", "given": "Ana"}, {"literal": "The Group"}, {"family": "Orr"}], "issued": {"date-parts": [[2020, 3]]}, "container-title": "Letters"}),
    ("b", {"DOI": "10.1/b", "title": None, "author": None, "issued": {"date-parts": []}}), ("c", "not json"), ("d", None),
))


@_q("s9_csl", f"""SELECT k, lower(json_extract_string(body, '$.DOI')) AS doi, json_extract_string(body, '$.title') AS title,
  array_to_string(list_transform(from_json(json_extract(body, '$.author'), '["JSON"]'), lambda a: coalesce(nullif(concat_ws(', ', json_extract_string(a, '$.family'), json_extract_string(a, '$.given')), ''), json_extract_string(a, '$.literal'))), '; ') AS authors,
  CAST(json_extract(body, '$.issued."date-parts"[0][0]') AS INT) AS year, json_extract_string(body, '$."container-title"') AS venue FROM {_CSL} WHERE json_valid(body)""")
def s9_csl(spark: SparkSession, d: str) -> DataFrame:
    return sv.csl(CSL(spark), "k", "body")


DATA, _DATA = _payload(_bodies(
    ("a", {"data": {"attributes": {"creators": [{"name": "Sato, Ana", "nameIdentifiers": [{"nameIdentifier": "https://orcid.org/0000-1", "nameIdentifierScheme": "ORCID"}]}, {"name": "Orr, Bo", "nameIdentifiers": [{"nameIdentifier": "x", "nameIdentifierScheme": "ISNI"}]}], "rightsList": [{"rights": "Open", "rightsUri": "http://o.test"}, {"rightsIdentifier": "cc-by-4.0", "rightsIdentifierScheme": "SPDX", "rightsUri": "http://cc.test"}], "relatedIdentifiers": [{"relationType": "IsCitedBy", "relatedIdentifier": f"10.1/{i}"} for i in range(12)], "types": {"resourceTypeGeneral": "Dataset"}}}}),
    ("b", {"data": {"attributes": {"creators": [], "rightsList": [{"rights": "Open", "rightsUri": "http://o.test"}], "types": {}}}}),
))


@_q("s9_datacite", "SELECT * FROM (VALUES ('a', 'Sato, Ana=0000-1', 'cc-by-4.0', 'http://cc.test', '" + "; ".join(f"IsCitedBy 10.1/{i}" for i in range(10)) + "', 'Dataset'), ('b', '', 'Open', 'http://o.test', '', NULL)) AS t(k, orcids, licence, licence_url, related, kind)")
def s9_datacite(spark: SparkSession, d: str) -> DataFrame:
    return sv.registry_record(DATA(spark), "k", "body")


WORKS, _WORKS = _payload(_bodies(("a", {"message": {"type": "journal-article", "is-referenced-by-count": 12, "license": [{"URL": "http://l.test", "content-version": "vor"}]}}), ("b", {"message": {"type": "tëxt"}}), ("c", {"status": "failed"})))


@_q("s9_crossref", f"SELECT k, CASE WHEN strlen(t) = length(t) THEN t END AS kind, CAST(json_extract(body, '$.message.\"is-referenced-by-count\"') AS INT) AS citations, coalesce(json_array_length(body, '$.message.license'), 0) AS licences FROM (SELECT *, json_extract_string(body, '$.message.type') AS t FROM {_WORKS}) WHERE json_extract(body, '$.message') IS NOT NULL")
def s9_crossref(spark: SparkSession, d: str) -> DataFrame:
    return sv.registered_work(WORKS(spark), "k", "body")


AGENCIES = [("10.48550", "DataCite"), ("10.1101", "Crossref"), ("10.5555", "Crossref")]


@_q("s9_agency", "SELECT record_id, a.agency FROM (SELECT record_id, any_value(doi) AS doi FROM citation_records GROUP BY record_id) r LEFT JOIN (" + values(AGENCIES, "prefix", "agency") + ") a ON a.prefix = split_part(regexp_replace(lower(trim(r.doi)), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', ''), '/', 1)")
def s9_agency(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "citation_records").dropDuplicates(["record_id"])
    prefix = F.split(F.regexp_replace(F.lower(F.trim("doi")), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", ""), "/")[0]
    return r.withColumn("prefix", prefix).join(F.broadcast(inline(spark, AGENCIES, "prefix string, agency string")), "prefix", "left").select("record_id", "agency")  # one row for each registrar's prefix asked


REFS, _REFS = _payload(_bodies(("p", {"data": [{"contexts": ["as in [3]", "see"], "citedPaper": {"paperId": "x", "title": "X", "year": 2001}}, {"citedPaper": {"paperId": "y", "title": None, "year": None}}, {"paperId": "z", "title": "Z", "year": 1999, "contexts": []}], "next": 3}), ("q", {"data": []})))


@_q("j14_contexts", f"SELECT k, json_extract(body, '$.next') IS NOT NULL AS more, pos, json_extract_string(c, '$.paperId') AS paperId, json_extract_string(c, '$.title') AS title, CAST(json_extract(c, '$.year') AS INT) AS year, coalesce(json_array_length(e, '$.contexts'), 0) AS contexts, json_extract_string(e, '$.contexts[0]') AS context FROM (SELECT *, coalesce(json_extract(e, '$.citedPaper'), e) AS c FROM {_each(_REFS, '$.data', more=', body')})")
def j14_contexts(spark: SparkSession, d: str) -> DataFrame:
    return sv.references(REFS(spark), "k", "body")


RFC, _RFC = _payload(_bodies(("a", {"doc_id": "RFC0793", "title": "Transport", "authors": ["J. P."], "status": "INTERNET STANDARD", "pub_date": "September 1981", "obsoletes": ["RFC0761 "], "obsoleted_by": ["RFC9293"]}), ("b", {"doc_id": "RFC9110", "title": "Semantics", "authors": ["A. B.", "C. D."], "status": "PROPOSED STANDARD"})))


@_q("s11_standard", f"SELECT k, regexp_replace(json_extract_string(body, '$.doc_id'), '^([A-Z]+)0*', '\\1 ') AS name, json_extract_string(body, '$.title') AS title, array_to_string(json_extract_string(body, '$.authors[*]'), ', ') AS authors, array_to_string(list_transform(string_split(lower(json_extract_string(body, '$.status')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS status, json_extract_string(body, '$.pub_date') AS pub_date, CASE WHEN json_extract(body, '$.obsoletes') IS NOT NULL THEN array_to_string(list_transform(json_extract_string(body, '$.obsoletes[*]'), lambda x: trim(x)), ', ') END AS obsoletes, CASE WHEN json_extract(body, '$.obsoleted_by') IS NOT NULL THEN array_to_string(json_extract_string(body, '$.obsoleted_by[*]'), ', ') END AS obsoleted_by FROM {_RFC}")
def s11_standard(spark: SparkSession, d: str) -> DataFrame:
    return sv.standard(RFC(spark), "k", "body")


FOUND, _FOUND = _payload(_bodies(("q", {"meta": {"total_count": 31}, "objects": [{"name": "rfc1", "title": "One", "pages": 3}, {"name": "rfc2", "title": "Two", "pages": None}]}), ("r", {"objects": [{"name": "rfc3", "title": "Three", "pages": 9}]})))


@_q("s11_search", f"SELECT k, coalesce(CAST(json_extract(body, '$.meta.total_count') AS BIGINT), 0) AS total, pos, json_extract_string(e, '$.name') AS name, json_extract_string(e, '$.title') AS title, CAST(json_extract(e, '$.pages') AS INT) AS pages FROM {_each(_FOUND, '$.objects', more=', body')}")
def s11_search(spark: SparkSession, d: str) -> DataFrame:
    return sv.standards_found(FOUND(spark), "k", "body")


XML = [("bcp14", '<referencegroup anchor="BCP14"><reference anchor="RFC2119"><front><title>Key words </title></front></reference><reference anchor="RFC8174"><front><title>Ambiguity</title></front></reference></referencegroup>'), ("std1", '<reference anchor="RFC5000"><front><title>Official</title></front></reference>')]


@_q("s11_subseries", "SELECT * FROM (VALUES ('bcp14', 0, 'RFC2119', 'Key words'), ('bcp14', 1, 'RFC8174', 'Ambiguity'), ('std1', 0, 'RFC5000', 'Official')) AS t(k, pos, member, title)")
def s11_subseries(spark: SparkSession, d: str) -> DataFrame:
    return sv.subseries(inline(spark, XML, "k string, body string"), "k", "body")


REPO, _REPO = _payload(_bodies(("a", {"full_name": "o/r", "description": "d", "stargazers_count": 5, "language": "Go", "license": {"spdx_id": "MIT"}, "topics": ["x", "y"], "pushed_at": "2024-01-02T03:04:05Z"}), ("b", {"full_name": "o/s", "license": {"spdx_id": "NOASSERTION"}, "archived": True})))


@_q("s12_repository", f"SELECT k, json_extract_string(body, '$.full_name') AS full_name, json_extract_string(body, '$.description') AS description, CAST(json_extract(body, '$.stargazers_count') AS BIGINT) AS stars, json_extract_string(body, '$.language') AS language, nullif(json_extract_string(body, '$.license.spdx_id'), 'NOASSERTION') AS licence, coalesce(CAST(json_extract(body, '$.archived') AS BOOLEAN), false) AS archived, CASE WHEN json_extract(body, '$.topics') IS NOT NULL THEN array_to_string(json_extract_string(body, '$.topics[*]'), ', ') END AS topics, left(json_extract_string(body, '$.pushed_at'), 10) AS pushed FROM {_REPO}")
def s12_repository(spark: SparkSession, d: str) -> DataFrame:
    return sv.repository(REPO(spark), "k", "body")


TREE, _TREES = _payload(_bodies(("o/r", {"truncated": True, "tree": [{"path": "src", "type": "tree"}, {"path": "src/a.go", "type": "blob", "size": 12}]}), ("o/s", {"tree": [{"path": "b.py", "type": "blob", "size": 0}]})))


@_q("s12_tree", f"SELECT k, coalesce(CAST(json_extract(body, '$.truncated') AS BOOLEAN), false) AS cut, json_extract_string(e, '$.path') AS path, json_extract_string(e, '$.type') = 'tree' AS folder, CAST(json_extract(e, '$.size') AS BIGINT) AS size FROM {_each(_TREES, '$.tree', more=', body')}")
def s12_tree(spark: SparkSession, d: str) -> DataFrame:
    return sv.file_tree(TREE(spark), "k", "body")


MODELS = [("a", '{"baseModels":{"relation":"quantized","models":[{"id":"org/base"}]}}', None), ("b", '{"baseModels":null,"cardData":{"base_model":["org/card","x"]}}', None), ("c", '{"cardData":{"base_model":"org/one"}}', None), ("d", '{"cardData":{"base_model":"not an id"}}', "---\nbase_model: org/line\n---"), ("e", "{}", "no line"), ("f", "broken", "base_model: 'org/q'")]


@_q("f21_base_model", "SELECT * FROM (VALUES ('a', 'org/base', 'quantized'), ('b', 'org/card', NULL), ('c', 'org/one', NULL), ('d', 'org/line', NULL), ('e', NULL, NULL), ('f', 'org/q', NULL)) AS t(k, base, relation)")
def f21_base_model(spark: SparkSession, d: str) -> DataFrame:
    return sv.base_model(inline(spark, MODELS, "k string, body string, card string"), "k", "body", "card")


VERSION, _VERSION = _payload(_bodies(("a", {"versionKey": {"name": "lib", "version": "1.2"}, "licenses": ["MIT", "BSD"], "advisoryKeys": [{"id": "G-1"}], "isDefault": True, "publishedAt": "2024-05-06T00:00:00Z"}), ("b", {"versionKey": {"name": "lib", "version": "0.1"}, "licenses": [], "advisoryKeys": []})))


@_q("s14_version", f"SELECT k, json_extract_string(body, '$.versionKey.name') AS name, json_extract_string(body, '$.versionKey.version') AS version, array_to_string(json_extract_string(body, '$.licenses[*]'), ', ') AS licences, array_to_string(json_extract_string(body, '$.advisoryKeys[*].id'), ', ') AS advisories, coalesce(CAST(json_extract(body, '$.isDefault') AS BOOLEAN), false) AS is_default, left(json_extract_string(body, '$.publishedAt'), 10) AS published FROM {_VERSION}")
def s14_version(spark: SparkSession, d: str) -> DataFrame:
    return sv.package_version(VERSION(spark), "k", "body")


DEPS, _DEPS = _payload(_bodies(("a", {"nodes": [{"versionKey": {"name": "lib", "version": "1"}, "relation": "SELF"}, {"versionKey": {"name": "x", "version": "2"}, "relation": "DIRECT"}, {"versionKey": {"name": "y", "version": "3"}, "relation": "INDIRECT"}], "edges": [{"fromNode": 0, "toNode": 1, "requirement": "^1"}, {"fromNode": 2, "toNode": 1, "requirement": "^2"}]})))


@_q("s14_dependencies", f"SELECT k, pos AS n, json_extract_string(e, '$.versionKey.name') AS name, json_extract_string(e, '$.versionKey.version') AS version, json_extract_string(e, '$.relation') AS relation, (SELECT arg_max(json_extract_string(x, '$.requirement'), p) FROM (SELECT unnest(l) AS x, generate_subscripts(l, 1) AS p FROM (SELECT from_json(json_extract(n.body, '$.edges'), '[\"JSON\"]') AS l)) WHERE CAST(json_extract(x, '$.toNode') AS INT) = n.pos) AS requirement FROM {_each(_DEPS, '$.nodes', more=', body')} n WHERE json_extract_string(e, '$.relation') <> 'SELF'")
def s14_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return sv.dependencies(DEPS(spark), "k", "body")


PROJECT, _PROJECT = _payload(_bodies(("a", {"projectKey": {"id": "github.com/o/r"}, "starsCount": 7, "forksCount": 1, "license": "MIT", "scorecard": {"overallScore": 6.5, "checks": [{"name": "Fuzzing", "score": 0}, {"name": "License", "score": 10}, {"name": "SAST", "score": -1}, {"name": "Pinned", "score": 5}]}})))


@_q("s14_project", f"SELECT k, json_extract_string(body, '$.projectKey.id') AS project, CAST(json_extract(body, '$.starsCount') AS BIGINT) AS stars, CAST(json_extract(body, '$.forksCount') AS BIGINT) AS forks, json_extract_string(body, '$.license') AS license, CAST(json_extract(body, '$.scorecard.overallScore') AS DOUBLE) AS score, array_to_string(list_transform(list_filter(from_json(json_extract(body, '$.scorecard.checks'), '[\"JSON\"]'), lambda c: CAST(json_extract(c, '$.score') AS INT) BETWEEN 0 AND 5), lambda c: json_extract_string(c, '$.name')), ', ') AS weak FROM {_PROJECT}")
def s14_project(spark: SparkSession, d: str) -> DataFrame:
    return sv.project(PROJECT(spark), "k", "body")


ADVISORY, _ADVISORY = _payload(_bodies(("a", {"advisoryKey": {"id": "G-1"}, "title": "Bad parse", "aliases": ["CVE-1", "X-2", "CVE-3"], "cvss3Score": 9.8, "url": "http://o.test"})))


@_q("s14_advisory", f"SELECT json_extract_string(body, '$.advisoryKey.id') AS id, json_extract_string(body, '$.title') AS title, array_to_string(list_filter(json_extract_string(body, '$.aliases[*]'), lambda a: starts_with(a, 'CVE-')), ', ') AS aliases, CAST(json_extract(body, '$.cvss3Score') AS DOUBLE) AS score, json_extract_string(body, '$.url') AS url, k FROM {_ADVISORY}")
def s14_advisory(spark: SparkSession, d: str) -> DataFrame:
    return sv.advisory(ADVISORY(spark), "k", "body")


ENVELOPES = _bodies(("a", {"data": {"is_suspended": True}}), ("b", {"error": 403, "reason": "private"}), ("c", {"error": 401, "message": "Unauthorized"}), ("d", {"error": 500, "message": "Oops"}), ("e", {"error": 404}), ("f", {"data": {"children": []}}), ("g", "broken"))


@_q("s15_errors", "SELECT k, CASE WHEN NOT json_valid(body) THEN NULL WHEN json_extract_string(body, '$.data.is_suspended') = 'true' THEN 'Error: This Reddit account is suspended.' WHEN json_extract(body, '$.error') IS NULL THEN NULL WHEN json_extract_string(body, '$.reason') = 'private' THEN 'Error: This subreddit is private.' WHEN json_extract_string(body, '$.message') = 'Unauthorized' THEN 'Error: Reddit returned Unauthorized.' ELSE rtrim('Error: Reddit API error ' || json_extract_string(body, '$.error') || ': ' || coalesce(json_extract_string(body, '$.message'), '')) END AS error FROM (" + values(ENVELOPES, "k", "body") + ")")
def s15_errors(spark: SparkSession, d: str) -> DataFrame:
    return inline(spark, ENVELOPES, "k string, body string").select("k", sv.community_error(F.col("body")).alias("error"))


LISTING, _LISTING = _payload(_bodies(("hot", {"data": {"after": "t3_z", "children": [{"kind": "t3", "data": {"id": "a", "title": "One", "author": "x", "score": 5, "num_comments": 2}}, {"kind": "t1", "data": {"id": "b", "body": "said", "author": "y", "score": -1}}]}})))


@_q("s15_listing", f"SELECT k, json_extract_string(body, '$.data.after') AS after, pos, json_extract_string(e, '$.kind') AS kind, json_extract_string(e, '$.data.id') AS id, json_extract_string(e, '$.data.title') AS title, json_extract_string(e, '$.data.body') AS body, json_extract_string(e, '$.data.author') AS author, CAST(json_extract(e, '$.data.score') AS BIGINT) AS score, CAST(json_extract(e, '$.data.num_comments') AS BIGINT) AS num_comments FROM {_each(_LISTING, '$.data.children', more=', body')}")
def s15_listing(spark: SparkSession, d: str) -> DataFrame:
    return sv.community_listing(LISTING(spark), "k", "body")


SEARCH, _SEARCH = _payload(_bodies(("q", {"posts": [{"id": 1, "topic_id": 7, "username": "ann", "blurb": "x"}, {"id": 2, "topic_id": 8, "username": "bob", "blurb": "y"}], "topics": [{"id": 7, "title": "Seven", "posts_count": 3}]})))


@_q("s16_search", f"SELECT p.k, p.pos, json_extract_string(p.e, '$.username') AS username, json_extract_string(p.e, '$.blurb') AS blurb, coalesce(json_extract_string(t.e, '$.title'), 'Untitled') AS title, coalesce(CAST(json_extract(t.e, '$.posts_count') AS BIGINT), 0) AS posts FROM {_each(_SEARCH, '$.posts')} p LEFT JOIN {_each(_SEARCH, '$.topics')} t ON t.k = p.k AND json_extract_string(t.e, '$.id') = json_extract_string(p.e, '$.topic_id')")
def s16_search(spark: SparkSession, d: str) -> DataFrame:
    return sv.forum_search(SEARCH(spark), "k", "body")


CHANNEL, _CHANNEL = _payload(_bodies(("c", {"title": "Chan", "channel_id": "UC1", "playlist_count": 9, "entries": [{"id": "v1", "title": "One", "duration": 61.0, "view_count": 5}, {"id": "v2", "title": None, "duration": None}]}), ("d", {"title": "Empty", "entries": []})))


@_q("g8_channel", "SELECT * FROM (VALUES ('c', E'## Recent uploads (2)\\n\\n1. One (01:01)\\n2. Untitled'), ('d', E'## Recent uploads (0)\\n\\n(no entries)')) AS t(k, text)")
def g8_channel(spark: SparkSession, d: str) -> DataFrame:
    return rp.video_document(sv.video_listing(CHANNEL(spark), "k", "body"), "k")


@_q("s18_entries", f"SELECT k, json_extract_string(body, '$.title') AS listing, json_extract_string(body, '$.channel_id') AS channel_id, CAST(json_extract(body, '$.playlist_count') AS BIGINT) AS total, pos, json_extract_string(e, '$.id') AS id, json_extract_string(e, '$.title') AS title, CAST(json_extract(e, '$.duration') AS DOUBLE) AS duration, CAST(json_extract(e, '$.view_count') AS BIGINT) AS view_count FROM {_each(_CHANNEL, '$.entries', more=', body')}")
def s18_entries(spark: SparkSession, d: str) -> DataFrame:
    return sv.video_listing(CHANNEL(spark), "k", "body").where("id IS NOT NULL")


COMMENTS, _COMMENTS = _payload(_bodies(("v", {"comments": [{"id": "a", "parent": "root", "author": "x", "text": "top", "like_count": 4}, {"id": "b", "parent": "a", "author": "y", "text": "reply", "like_count": 0}, {"id": "c", "parent": "root", "author": "z", "text": "second", "like_count": None}]})))


@_q("t10_replies", f"SELECT k, pos, json_extract_string(e, '$.id') AS id, json_extract_string(e, '$.text') AS text FROM {_each(_COMMENTS, '$.comments')} WHERE json_extract_string(e, '$.parent') = 'a'")
def t10_replies(spark: SparkSession, d: str) -> DataFrame:
    return sv.video_comments(COMMENTS(spark), "k", "body").where("parent = 'a'").select("k", "pos", "id", "text")


@_q("t10_overview", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS k FROM events) WHERE k <= 50")
def t10_overview(spark: SparkSession, d: str) -> DataFrame:
    """The 50 best comments of each video (events of each user), the rank kept small before the shuffle."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc_nulls_last("value"), "event_id"))
    return table(spark, d, "events").withColumn("k", k).where("k <= 50").select("user_id", "event_id", "value")


WEB, _WEB = _payload(_bodies(("q", {"data": [{"t": 0, "rank": 1, "url": "http://a", "title": "A", "published": "2024-02-01T00:00:00Z"}, {"t": 0, "rank": 2, "url": "http://b", "title": "B"}, {"t": 1}, {"t": 0, "rank": 3, "url": "http://c", "title": "C", "published": "2023-12-31"}]})))


@_q("s19_web_search", f"SELECT k, CAST(json_extract(e, '$.rank') AS INT) AS rank, json_extract_string(e, '$.url') AS url, json_extract_string(e, '$.title') AS title, left(json_extract_string(e, '$.published'), 10) AS day FROM {_each(_WEB, '$.data')} WHERE json_extract_string(e, '$.t') = '0' AND left(json_extract_string(e, '$.published'), 10) >= '2024-01-01'")
def s19_web_search(spark: SparkSession, d: str) -> DataFrame:
    return sv.web_results(WEB(spark), "k", "body", after="2024-01-01")


@_q("s21_scorecards", "SELECT r.repo, s.score, s.repo IS NULL AS negative FROM (SELECT DISTINCT repo FROM source_files WHERE repo IS NOT NULL) r LEFT JOIN (SELECT repo, count(DISTINCT file_id) % 11 AS score FROM source_files WHERE ext = 'go' GROUP BY repo) s ON s.repo = r.repo")
def s21_scorecards(spark: SparkSession, d: str) -> DataFrame:
    """Scores of repositories; those that were asked for and have none are remembered as such."""
    f = table(spark, d, "source_files")
    scores = f.where("ext = 'go'").groupBy("repo").agg((F.count_distinct("file_id") % 11).alias("score"), F.lit(True).alias("there"))
    return f.where("repo IS NOT NULL").select("repo").distinct().join(scores, "repo", "left").select("repo", "score", F.col("there").isNull().alias("negative"))


_FETCHED = "(SELECT fetch_id, any_value(TRY(decode(content))) AS h FROM fetch_responses WHERE status_code = 200 AND content IS NOT NULL GROUP BY fetch_id)"


@_q("s22_sparse", f"SELECT fetch_id, length(trim(regexp_replace(regexp_replace(h, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>|\\s+', ' ', 'g'))) < 500 AS sparse FROM {_FETCHED} WHERE h IS NOT NULL AND h LIKE '%<html%'")
def s22_sparse(spark: SparkSession, d: str) -> DataFrame:
    """Rendered pages of so little text that an embedded frame takes their place."""
    r = table(spark, d, "fetch_responses").where("status_code = 200 AND content IS NOT NULL").dropDuplicates(["fetch_id"])
    h = r.select("fetch_id", F.try_validate_utf8(F.col("content").cast("string")).alias("h")).where("h LIKE '%<html%'")
    text = F.regexp_replace(F.regexp_replace("h", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>|\s+", " ")
    return h.select("fetch_id", (F.length(F.trim(text)) < 500).alias("sparse"))


PAGE = [("p", '<a href="/x">One</a><a href="/x">again</a><button>Go</button><input name="q" placeholder="Search"><select id="s"><option>1</option></select><a>none</a>')]


@_q("s23_elements", "SELECT * FROM (VALUES ('p', 0, 'a', 'One', '/x'), ('p', 1, 'button', 'Go', ''), ('p', 2, 'input', 'Search', 'q'), ('p', 3, 'select', '1', 's')) AS t(k, pos, kind, label, target)")
def s23_elements(spark: SparkSession, d: str) -> DataFrame:
    import pandas as pd

    from sheaf.operators.html import interactive_elements

    fn = F.pandas_udf(lambda s: pd.Series([interactive_elements(p) for p in s]), "array<struct<kind:string,label:string,target:string>>")
    return inline(spark, PAGE, "k string, page string").select("k", F.posexplode(fn("page")).alias("pos", "e")).select("k", "pos", "e.*")


WIKIP, _WIKIP = _payload(_bodies(("w", {"parse": {"displaytitle": "<i>River</i> ", "pageid": 5, "text": {"*": "<p>x</p>"}}}), ("x", {"error": {"code": "missing"}})))


@_q("s6_page", "SELECT * FROM (VALUES ('w', 5, 'River', '<p>x</p>')) AS t(k, pageid, title, html)")
def s6_page(spark: SparkSession, d: str) -> DataFrame:
    return sv.wiki_page(WIKIP(spark), "k", "body")


ATOM = [("q", '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://a/1</id><title>One\n two</title><published>2024-01-01</published></entry><entry><id>http://a/2</id><title>B</title><published>2024-02-01</published></entry></feed>')]


@_q("s8_atom", "SELECT * FROM (VALUES ('q', 0, 'http://a/1', 'One two', '2024-01-01'), ('q', 1, 'http://a/2', 'B', '2024-02-01')) AS t(k, pos, id, title, published)")
def s8_atom(spark: SparkSession, d: str) -> DataFrame:
    from sheaf.sources.payloads import atom_entries

    return atom_entries(inline(spark, ATOM, "k string, body string"), "k", "body")


PAPERS, _PAPERS = _payload(_bodies(("q", {"total": 2, "offset": 0, "data": [{"paperId": "x", "title": "X", "year": 2001, "authors": [{"name": "A"}, {"name": "B"}], "citationCount": 4}, {"paperId": "y", "title": None, "year": None, "authors": [], "citationCount": None}]})))


@_q("s10_papers", f"SELECT k, 2 AS total, pos, json_extract_string(e, '$.paperId') AS paperId, json_extract_string(e, '$.title') AS title, CAST(json_extract(e, '$.year') AS INT) AS year, array_to_string(json_extract_string(e, '$.authors[*].name'), ', ') AS authors, CAST(json_extract(e, '$.citationCount') AS BIGINT) AS citationCount FROM {_each(_PAPERS, '$.data')}")
def s10_papers(spark: SparkSession, d: str) -> DataFrame:
    from sheaf.sources.payloads import papers

    return papers(PAPERS(spark), "k", "body")


CONFIGS, _CONFIGS = _payload(_bodies(("flat", {"hidden_size": 8, "num_hidden_layers": 2, "vocab_size": True, "torch_dtype": "bfloat16", "num_local_experts": 4}), ("nested", {"hidden_size": 1, "text_config": {"hidden_size": 16, "num_hidden_layers": 3, "num_attention_heads": 4}})))


@_q("s13_config", "SELECT * FROM (VALUES ('flat', 8, 2, NULL, NULL, NULL, 4, 'bfloat16'), ('nested', 16, 3, 4, NULL, NULL, NULL, NULL)) AS t(k, hidden_size, num_hidden_layers, num_attention_heads, num_key_value_heads, vocab_size, experts, dtype)")
def s13_config(spark: SparkSession, d: str) -> DataFrame:
    from sheaf.sources.payloads import model_config

    return model_config(CONFIGS(spark), "k", "body")


# documents


@_q("g5_issue", """WITH i AS (SELECT o_orderkey AS issue, 'org/' || lower(o_orderpriority) AS repo, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'closed' END AS state, 'c' || o_custkey AS author, o_orderpriority AS body FROM orders WHERE o_orderkey % 7 = 0),
c AS (SELECT l_orderkey AS issue, l_linenumber AS id, 's' || l_suppkey AS author, CASE WHEN l_returnflag = 'R' THEN 'MEMBER' ELSE 'NONE' END AS association, l_linestatus AS body FROM lineitem), n AS (SELECT issue, count(*) AS n FROM c GROUP BY issue)
SELECT issue, 0 AS part, 0 AS pos, '**' || repo || '#' || issue || '** | ' || state || ' | ' || coalesce(n, 0) || ' comments' AS line FROM i LEFT JOIN n USING (issue)
UNION ALL SELECT issue, 1, 0, '**@' || author || '**' FROM i UNION ALL SELECT issue, 2, 0, body FROM i WHERE body IS NOT NULL
UNION ALL SELECT issue, 3, 0, 'Showing 3 of ' || n || ' comments. Use page= for more.' FROM i JOIN n USING (issue) WHERE n > 3
UNION ALL SELECT c.issue, 4, k, '### ic_' || id || E'\\n\\n**@' || c.author || '**' || CASE WHEN association <> 'NONE' THEN ' (' || association || ')' ELSE '' END || E'\\n\\n' || coalesce(c.body, '') FROM (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY id, author, association, body) AS k FROM c) c JOIN i ON i.issue = c.issue WHERE k <= 3""".replace("WHERE o_orderkey % 7 = 0", ""))
def g5_issue(spark: SparkSession, d: str) -> DataFrame:
    """Orders as issues, their lines as comments: heads, bodies, and the first three comments of each."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    issues = o.select(F.col("o_orderkey").alias("issue"), F.concat(F.lit("org/"), F.lower("o_orderpriority")).alias("repo"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("state"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("author"), F.lit("NONE").alias("association"), F.col("o_orderpriority").alias("body"))
    comments = li.select(F.col("l_orderkey").alias("issue"), F.col("l_linenumber").alias("id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("author"), F.when(F.col("l_returnflag") == "R", "MEMBER").otherwise("NONE").alias("association"), F.col("l_linestatus").alias("body"))
    return rp.issue_lines(issues, comments, most=3)


@_q("g5_pull_files", "SELECT pull, string_agg('- `' || path || '` (+' || added || ' −' || removed || ')', chr(10) ORDER BY k) || CASE WHEN max(n) > 5 THEN E'\\n- … and ' || (max(n) - 5) || ' more' ELSE '' END AS text FROM (SELECT repo AS pull, path, length(path) AS added, length(path) % 7 AS removed, row_number() OVER (PARTITION BY repo ORDER BY path) AS k, count(*) OVER (PARTITION BY repo) AS n FROM (SELECT DISTINCT repo, path FROM source_files WHERE repo IS NOT NULL AND path IS NOT NULL)) WHERE k <= 5 GROUP BY pull")
def g5_pull_files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").where("repo IS NOT NULL AND path IS NOT NULL").select(F.col("repo").alias("pull"), "path").distinct()
    return rp.pull_files(f.withColumn("added", F.length("path")).withColumn("removed", F.length("path") % 7), most=5)


TEMPLATES = [("o/a", ".github/ISSUE_TEMPLATE/bug.yml", None), ("o/a", ".github/ISSUE_TEMPLATE/idea.md", None), ("o/a", ".github/ISSUE_TEMPLATE/config.yml", "blank_issues_enabled: false\ncontact_links: []"), ("o/b", ".github/ISSUE_TEMPLATE/config.yml", "blank_issues_enabled: true"), ("o/c", "README.md", None), ("o/d", ".github/ISSUE_TEMPLATE/x.yaml", None)]


@_q("g6_templates", "SELECT * FROM (VALUES ('o/a', 1, 1, false, '1 issue forms; 1 templates; blank issues are off'), ('o/d', 1, 0, true, '1 issue forms')) AS t(repo, forms, templates, blank, note)")
def g6_templates(spark: SparkSession, d: str) -> DataFrame:
    return rp.template_notes(inline(spark, TEMPLATES, "repo string, path string, content string"))


@_q("g11_transcript", f"WITH s AS ({'SELECT * FROM (' + _AWARE.split('seg AS ')[1].split(', per AS')[0] + ')'}), {_CHAP} SELECT video_id, 0 AS part, start_time AS at, pos, '- [' || {_MMSS} || '] ' || title AS line FROM (SELECT *, start_time AS start FROM c) WHERE title IS NOT NULL UNION ALL SELECT video_id, 1, start_time, -1, '## ' || title FROM c WHERE title IS NOT NULL UNION ALL SELECT video_id, 1, start, seg_idx, '[' || {_MMSS} || '] ' || text FROM s")
def g11_transcript(spark: SparkSession, d: str) -> DataFrame:
    return rp.transcript_lines(_segments(spark, d), _chapters(spark, d), "video_id")


@_q("g10_file_slices", f"SELECT doc_id, length(to_json({{{{'doc_id': doc_id, 'lang': lang, 'site': site}}}})) > 0 AS there FROM documents".replace("{{", "{").replace("}}", "}"))
def g10_file_slices(spark: SparkSession, d: str) -> DataFrame:
    """A JSON file is printed with line breaks before it is cut, so that it has lines to cut at."""
    j = table(spark, d, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", "site"), {"pretty": "true", "ignoreNullFields": "false"}).alias("j"))
    return st.chunks(j, "doc_id", "j", "lines").where("idx = 0").select("doc_id", F.contains("text", F.lit("\n")).alias("there"))


@_q("g10_model_card", "SELECT repo, concat_ws(' | ', CASE WHEN files <> '' THEN 'see ' || files || ' for the full document' END, 'base model ' || base) AS hints FROM (SELECT m.repo, m.base, coalesce((SELECT string_agg('''' || m.repo || '/' || path || '''', ' or ' ORDER BY path) FROM (SELECT DISTINCT path FROM (VALUES ('o/a', 'config.json'), ('o/a', 'model.safetensors.index.json'), ('o/b', 'x.bin')) AS s(repo, path) WHERE s.repo = m.repo AND path IN ('config.json', 'model.safetensors.index.json'))), '') AS files FROM (VALUES ('o/a', 'o/base'), ('o/b', NULL), ('o/c', 'o/z')) AS m(repo, base))")
def g10_model_card(spark: SparkSession, d: str) -> DataFrame:
    return rp.model_hints(inline(spark, [("o/a", "o/base"), ("o/b", None), ("o/c", "o/z")], "repo string, base string"), inline(spark, [("o/a", "config.json"), ("o/a", "model.safetensors.index.json"), ("o/b", "x.bin")], "repo string, path string"))


CFF = [("a", "cff-version: 1.2.0\ntitle: Tool\nauthors:\n  - family-names: Sato\n    given-names: Ana\n  - name: The Group\ndate-released: 2021-05-01\n"), ("b", "title: Tool\ndoi: 10.1/soft\nauthors:\n- family-names: Orr\npreferred-citation:\n  type: article\n  title: \"The paper\"\n  doi: 10.1/paper\n  year: 2019\n  authors:\n    - family-names: Poe\n      given-names: Bo\n"), ("c", ""), ("d", None)]


@_q("f20_citation_file", "SELECT * FROM (VALUES ('a', NULL, 'Tool', 'Sato, Ana; The Group', 2021), ('b', '10.1/paper', 'The paper', 'Poe, Bo', 2019), ('c', NULL, 'Untitled', '', NULL), ('d', NULL, 'Untitled', '', NULL)) AS t(k, doi, title, authors, year)")
def f20_citation_file(spark: SparkSession, d: str) -> DataFrame:
    return inline(spark, CFF, "k string, cff string").select("k", rp.citation_file(F.col("cff")).alias("c")).select("k", "c.*")


QUOTAS = [(1, 5, 60, False), (2, 5, 60, True), (3, 10, 60, False), (4, 0, 60, False), (5, None, None, False)]


@_q("f42_quota", "SELECT id, CASE WHEN remaining < 10 AND NOT token THEN 'GitHub API rate limit low (' || remaining || '/' || \"limit\" || ' remaining). Set GITHUB_TOKEN for 5000 req/hr.' END AS warning FROM (" + values(QUOTAS, "id", "remaining", '"limit"', "token") + ")")
def f42_quota(spark: SparkSession, d: str) -> DataFrame:
    return inline(spark, QUOTAS, "id long, remaining long, limit long, token boolean").select("id", rp.quota_warning(F.col("remaining"), F.col("limit"), F.col("token")).alias("warning"))


@_q("f43_see_also", "SELECT record_id, concat_ws('; ', CASE WHEN lower(doi) LIKE '10.48550/arxiv.%' THEN 'arxiv.org/abs/' || split_part(lower(doi), 'arxiv.', 2) END, CASE WHEN doi IS NOT NULL AND NOT lower(doi) LIKE '10.48550/arxiv.%' THEN 'doi.org/' || lower(doi) END) AS see_also FROM (SELECT record_id, any_value(doi) AS doi FROM citation_records GROUP BY record_id)")
def f43_see_also(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "citation_records").dropDuplicates(["record_id"]).withColumn("l", F.lower("doi"))
    pre = F.col("l").startswith("10.48550/arxiv.")
    return r.select("record_id", F.concat_ws("; ", F.when(pre, F.concat(F.lit("arxiv.org/abs/"), F.substring_index("l", "arxiv.", -1))), F.when(~pre, F.concat(F.lit("doi.org/"), F.col("l")))).alias("see_also"))


SEARCHES = [("repo:o/a label:bug", 0), ('repo:"o/a" label:"needs care" x', 0), ("repo:o/a label:ok", 3), ("label:bug", 0), ("repo:o/z label:bug", 0)]
LABELS = [("o/a", "feature"), ("o/a", "defect"), ("o/b", "bug"), ("o/a", None)]


@_q("q11_label_advice", "SELECT * FROM (VALUES ('repo:o/a label:bug', 'label:bug matched nothing — o/a uses: defect, feature'), ('repo:\"o/a\" label:\"needs care\" x', 'label:needs care matched nothing — o/a uses: defect, feature')) AS t(query, advice)")
def q11_label_advice(spark: SparkSession, d: str) -> DataFrame:
    return rp.label_advice(inline(spark, SEARCHES, "query string, hits long"), inline(spark, LABELS, "repo string, name string"))


@_q("e7_repositories", "SELECT DISTINCT 'github:' || lower(repo) AS doi, repo AS title, 'github' AS source_tool FROM source_files WHERE repo IS NOT NULL")
def e7_repositories(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "source_files").where("repo IS NOT NULL").select("repo").distinct()
    return rp.repository_records(r).select("doi", "title", "source_tool")


@_q("j15_siblings", "SELECT d.file_id, d.name, f.repo, f.path FROM (SELECT DISTINCT file_id, name FROM code_definitions) d LEFT JOIN (SELECT file_id, any_value(repo) AS repo, any_value(path) AS path FROM source_files GROUP BY file_id) f USING (file_id)")
def j15_siblings(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").dropDuplicates(["file_id"]).select("file_id", "repo", "path")
    return table(spark, d, "code_definitions").select("file_id", "name").distinct().join(f, "file_id", "left").select("file_id", "name", "repo", "path")


@_q("t9_code_search", "SELECT path, file_id, repo FROM (SELECT file_id, any_value(path) AS path, any_value(repo) AS repo FROM source_files GROUP BY file_id) WHERE starts_with(path, 'src/') ORDER BY path, file_id LIMIT 30")
def t9_code_search(spark: SparkSession, d: str) -> DataFrame:
    """Files under a prefix, the first 30 by path."""
    f = table(spark, d, "source_files").dropDuplicates(["file_id"]).select("path", "file_id", "repo")
    return f.where(F.col("path").startswith("src/")).orderBy("path", "file_id").limit(30)


@_q("x24_code_sections", "SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY start_line, end_line, name) - 1 AS idx, repeat('  ', CAST(depth AS BIGINT)) || '- ' || name AS line, start_line, end_line FROM (SELECT DISTINCT file_id, name, depth, start_line, end_line FROM code_definitions)")
def x24_code_sections(spark: SparkSession, d: str) -> DataFrame:
    """A source file's definitions as its sections, by line."""
    from pyspark.sql import Window

    c = table(spark, d, "code_definitions").select("file_id", "name", "depth", "start_line", "end_line").distinct()
    idx = F.row_number().over(Window.partitionBy("file_id").orderBy("start_line", "end_line", "name")) - 1
    return c.select("file_id", idx.alias("idx"), F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), "name").alias("line"), "start_line", "end_line")


# sections and slices of whole tables


@_q("x27_truncated", f"{_PACK}, u AS (SELECT doc_id, idx, n, sum(n) OVER w AS s, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM chunk WINDOW w AS (PARTITION BY doc_id ORDER BY idx)) SELECT doc_id, count(*) FILTER (idx = 0 OR s <= 2500 OR u < 1250) AS kept, count(*) FILTER (NOT (idx = 0 OR s <= 2500 OR u < 1250)) > 0 AS cut FROM u GROUP BY doc_id")
def x27_truncated(spark: SparkSession, d: str) -> DataFrame:
    c = st.chunks(table(spark, d, "documents"), "doc_id", "text", "lines")
    return st.packed(c, "doc_id", "idx", F.length("text"), 2500).groupBy("doc_id").agg(F.count("*").alias("kept"), F.max("cut").alias("cut"))


@_q("x28_entries", "WITH e AS (SELECT doc_id, section_no, length(name) AS n FROM (SELECT doc_id, section_no, max(name) AS name FROM sections GROUP BY doc_id, section_no)), u AS (SELECT *, row_number() OVER w AS k, sum(n) OVER w + row_number() OVER w - 1 AS used FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY section_no)) SELECT doc_id, section_no, k = 1 OR used <= 60 AS kept FROM u")
def x28_entries(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sections").groupBy("doc_id", "section_no").agg(F.max("name").alias("name"))
    return st.entries_within(s, "doc_id", "section_no", F.length("name"), 60).select("doc_id", "section_no", "kept")


@_q("x23_sections_only", f"WITH p AS (SELECT * FROM {_PARENT}), t AS (SELECT s.doc_id, s.idx, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.idx) - 1 AS n, count(*) OVER (PARTITION BY s.doc_id) AS total, repeat('  ', CAST(s.level - min(s.level) OVER (PARTITION BY s.doc_id) AS BIGINT)) || '- ' || CASE WHEN count(*) OVER (PARTITION BY s.doc_id, s.name) > 1 AND q.name IS NOT NULL THEN s.name || ' (' || q.name || ')' ELSE s.name END || CASE WHEN s.header_only THEN ' [header only]' ELSE '' END AS line FROM p s LEFT JOIN p q ON q.doc_id = s.doc_id AND q.idx = s.parent) SELECT doc_id, idx, line, n // 3 AS page, (total + 2) // 3 AS pages FROM t WHERE n // 3 = least(1, (total + 2) // 3 - 1)")
def x23_sections_only(spark: SparkSession, d: str) -> DataFrame:
    """The second page, of three entries, of each document's contents; the last where there is none."""
    from pyspark.sql import Window

    s = latest(table(spark, d, "sections"), ["doc_id", "section_no"], "extracted_at", ["name", "level", "start_pos", "end_pos", "header_only"]).where("level IS NOT NULL").withColumnRenamed("section_no", "idx")
    toc = st.table_of_contents(s, "doc_id", "idx")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")) - 1
    at = st.contents_page(F.count("*").over(Window.partitionBy("doc_id")), F.lit(1), 3)
    return toc.withColumn("n", n).withColumn("p", at).where((F.col("n") >= F.col("p.start")) & (F.col("n") < F.col("p.start") + 3)).select("doc_id", "idx", "line", "p.page", "p.pages")


@_q("x22_pipeline", """WITH s AS (SELECT doc_id, section_no, max(name) AS name, max(start_pos) AS a, max(end_pos) AS b FROM sections GROUP BY doc_id, section_no),
f AS (SELECT doc_id, arg_min(a, section_no) AS a, arg_min(coalesce(b, 1000000000), section_no) AS b FROM s WHERE name = 'Summary' GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN f.doc_id IS NULL THEN 'sections_not_found: Summary' END AS note, length(left(substr(d.text, CAST(f.a + 1 AS BIGINT), CAST(least(f.b, length(d.text)) - f.a AS BIGINT)), 400)) AS shown, least(f.b, length(d.text)) - f.a > 400 AS cut
FROM (SELECT DISTINCT doc_id FROM s) q JOIN documents d USING (doc_id) LEFT JOIN f USING (doc_id) WHERE d.text IS NOT NULL""")
def x22_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The section named Summary of every document with sections: found, cut to 100 tokens, or noted as not found."""
    s = table(spark, d, "sections").groupBy("doc_id", "section_no").agg(F.max("name").alias("name"), F.max("start_pos").alias("a"), F.max("end_pos").alias("b"))
    f = s.where("name = 'Summary'").groupBy("doc_id").agg(F.min_by("a", "section_no").alias("a"), F.min_by(F.coalesce("b", F.lit(1_000_000_000)), "section_no").alias("b"), F.lit(True).alias("there"))
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text").join(s.select("doc_id").distinct(), "doc_id").join(f, "doc_id", "left")
    body = F.substring("text", F.col("a") + 1, F.least("b", F.length("text")) - F.col("a"))
    return docs.select("doc_id", F.when(F.col("there").isNull(), "sections_not_found: Summary").alias("note"), F.length(st.hard_cut(body, 100)["shown"]).alias("shown"), (F.least("b", F.length("text")) - F.col("a") > 400).alias("cut"))


@_q("q10_dispatch", f"{_WIN}, {_CHAP}, h AS (SELECT w.video_id, w.win, w.start, (SELECT arg_min(title, pos) FROM c WHERE c.video_id = w.video_id AND c.start_time <= w.start AND w.start < c.end_time AND title IS NOT NULL) AS chapter FROM w WHERE hit) SELECT video_id, win, chapter, row_number() OVER (PARTITION BY video_id ORDER BY start, win) AS place FROM h WHERE lower(chapter) LIKE '%a%'")
def q10_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Windows with a word, in chapters whose title has a letter, in the order of time."""
    from pyspark.sql import Window

    from sheaf.operators import timed as tm
    from sheaf.operators.search import terms

    w = _windows(spark, d).groupBy("video_id", "win").agg(F.min("start").alias("start"), F.max(F.array_contains(terms(F.col("text")), "checkpoint").cast("int")).alias("hit"))
    h = tm.chapter_of(w.where("hit = 1"), _chapters(spark, d), "video_id", "start").where("lower(chapter) LIKE '%a%'")
    return h.select("video_id", "win", "chapter", F.row_number().over(Window.partitionBy("video_id").orderBy("start", "win")).alias("place"))


# answers, caches, catalogues


@_q("k4_answer", "SELECT doc_id, concat_ws(chr(10), '---', CASE WHEN lang IS NOT NULL THEN 'lang: ' || lang END, CASE WHEN site IS NOT NULL THEN 'site: ' || site END, 'sections_not_found:' || chr(10) || '  - \"Missing\"', '---') AS head FROM documents")
def k4_answer(spark: SparkSession, d: str) -> DataFrame:
    """Frontmatter of every document, with a section that was asked for and is not there."""
    from sheaf.operators.render import frontmatter

    one = lambda k: F.struct(F.lit(k).alias("key"), F.when(F.col(k).isNotNull(), F.array(k)).alias("values"))
    return table(spark, d, "documents").select("doc_id", frontmatter(F.array(one("lang"), one("site")), F.array(F.lit("Missing"))).alias("head"))


@_q("m2_group_eviction", "SELECT * FROM (VALUES (1, false, NULL), (2, false, NULL), (3, false, 'a,b'), (4, true, NULL), (5, false, NULL), (6, false, 'd')) AS t(n, hit, evicted)")
def m2_group_eviction(spark: SparkSession, d: str) -> DataFrame:
    """A cache of two whose pages of one group leave together; a page asked for again outlasts new ones."""
    from sheaf.operators.state import grouped_trace

    rows = [("u", 1, "a", "g"), ("u", 2, "b", "g"), ("u", 3, "c", None), ("u", 4, "c", None), ("u", 5, "d", None), ("u", 6, "e", None)]
    return grouped_trace(inline(spark, rows, "u string, n int, page string, grp string"), "u", "page", "grp", ["n"], most=2).select("n", "hit", "evicted")


REGIONS = [("de", "Germany"), ("fr", "France"), ("jp", "Japan"), ("us", "United States")]


@_q("catalog_regions", "SELECT * FROM (" + values(REGIONS, "code", "name") + ")")
def catalog_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions a search may name: a table of literals that other plans broadcast."""
    return inline(spark, REGIONS, "code string, name string")


@_q("ext_own_splitter", "SELECT doc_id, generate_subscripts(p, 1) - 1 AS idx, length(unnest(p)) AS n FROM (SELECT doc_id, list_filter(string_split(text, E'\\n\\n'), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL)")
def ext_own_splitter(spark: SparkSession, d: str) -> DataFrame:
    """A splitter of a user's own, registered under a name."""
    st.register_splitter("paragraphs", lambda t: [(i, 0, p) for i, p in enumerate(x for x in t.split("\n\n") if x)])
    return st.chunks(table(spark, d, "documents"), "doc_id", "text", "paragraphs").select("doc_id", "idx", F.length("text").alias("n"))
