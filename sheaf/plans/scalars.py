"""Scalar functions over whole tables and over inline rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import text as tx
from sheaf.functions import urls as u
from sheaf.plans.fixtures import inline, values
from sheaf.sources.tables import table

URLS = [
    (1, "https://arxiv.org/abs/2501.16496v1"), (2, "http://export.arxiv.org/pdf/1706.03762"), (3, "https://arxiv.org/html/2501.16496v2#S1"),
    (4, "https://doi.org/10.1145/3292500.3330701"), (5, "https://DX.doi.org/10.48550/arXiv.2501.16496"),
    (6, "https://www.semanticscholar.org/paper/Some-Title/204e3073870fae3d05bcbc2f6a8e263d9b72e776"), (7, "https://www.rfc-editor.org/rfc/rfc9110.json"), (8, "https://www.rfc-editor.org/rfc/rfc9110.html"),
    (9, "https://datatracker.ietf.org/doc/rfc2119/"), (10, "https://datatracker.ietf.org/doc/draft-ietf-quic-http-34"),
    (11, "https://www.reddit.com/r/spark/comments/abc123/some_title/def456/"), (12, "https://old.reddit.com/r/spark.json?sort=top&x=1"), (13, "https://redd.it/xyz"), (14, "https://np.reddit.com/user/someone"), (15, "https://reddit.com/r/spark/search?q=a&sort=new"),
    (16, "https://github.com/apache/spark"), (17, "https://github.com/apache/spark/blob/master/pom.xml#L10-L20"), (18, "https://github.com/apache/spark/pull/42?x=1"), (19, "https://github.com/apache/spark/issues/7"), (20, "https://github.com/apache"), (21, "https://github.com/settings/profile"),
    (22, "https://raw.githubusercontent.com/apache/spark/main/docs/a.md"), (23, "https://gist.github.com/user/0123abcd"), (24, "https://github.com/apache/spark/tree/branch-4.0/python/docs"), (25, "https://github.com/apache/spark/wiki/Page"), (26, "https://github.com/apache/spark/releases/tag/v1"), (27, "https://github.com/apache/spark/discussions/5"),
    (28, "https://huggingface.co/org/model"), (29, "https://huggingface.co/org/model/tree/main/sub/dir"), (30, "https://huggingface.co/org/model/blob/v1/config.json"), (31, "https://huggingface.co/datasets/org/set"), (32, "https://huggingface.co/blog/post"), (33, "https://huggingface.co/org"), (34, "https://huggingface.co/org/model/commit/0123456789abcdef"),
    (35, "https://www.youtube.com/watch?t=3&v=abcdefghijk"), (36, "https://youtu.be/abcdefghijk"), (37, "https://music.youtube.com/watch?v=abcdefghijk"), (38, "https://www.youtube.com/@handle"), (39, "https://www.youtube.com/playlist?list=PL123"), (40, "https://www.youtube.com/channel/UC0123456789012345678901"), (41, "https://youtube.com/shorts/abcdefghijk"),
    (42, "https://forum.test/t/some-slug/12345/3"), (43, "https://forum.test/sub/t/99?page=2#p"), (44, "ftp://files.test/x"), (45, "HTTP://UPPER.test/#frag"), (46, ""), (47, None), (48, "not a url"), (49, "https://host.test/a#"),
]


def _urls(spark: SparkSession, d: str) -> DataFrame:
    own = inline(spark, URLS, "id long, url string")
    return own.unionByName(table(spark, d, "documents").select((F.col("doc_id") + 1000).alias("id"), "url"))


_URL_SQL = "(" + values(URLS, "id", "url") + " UNION ALL SELECT doc_id + 1000 AS id, url FROM documents)"
_PATH = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', '')"


def _ex(pattern: str, group: int = 1, value: str = "url", flags: str = "i") -> str:
    return f"nullif(regexp_extract({value}, '{pattern}', {group}, '{flags}'), '')"


_TOPIC = r"/t/(?:[^/]*/)?(\d+)(?:/\d+)?/?$"
_SQL_ARXIV = _ex(r"https?://(?:export\.)?arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5}(?:v\d+)?)")
_SQL_DOI = _ex(r"https?://(?:dx\.)?doi\.org/(10\.\S+)")
_SQL_PAPER = _ex(r"https?://(?:www\.)?semanticscholar\.org/paper/(?:[^/]+/)?([0-9a-f]{40})")
_SQL_RFC = "coalesce(" + _ex(r"https?://www\.rfc-editor\.org/rfc/rfc(\d+)(?:\.json)?(?:[/?#]|$)") + ", " + _ex(r"https?://datatracker\.ietf\.org/doc/rfc(\d+)") + ")"
_SQL_DRAFT = f"CASE WHEN {_SQL_RFC} IS NULL THEN " + _ex(r"https?://datatracker\.ietf\.org/doc/(draft-[\w.-]+)") + " END"
_SQL_REDDIT = f"CASE WHEN regexp_matches(url, '^https?://redd\\.it/\\w+', 'i') THEN 'short_link' WHEN regexp_matches(url, '^https?://(?:(?:www|old|new|np)\\.)?reddit\\.com/', 'i') THEN CASE WHEN regexp_matches({_PATH}, '/(?:r/[^/]+/)?comments/\\w+', 'i') THEN 'comment_thread' WHEN regexp_matches({_PATH}, '/search/?$', 'i') THEN 'search' WHEN regexp_matches({_PATH}, '/(?:u|user)/[^/]+', 'i') THEN 'user' ELSE 'subreddit' END END"
_YT = r"https?://(?:www\.|m\.)?youtube\.com/"
_SQL_VIDEO = "coalesce(" + _ex(_YT + r"(?:watch\?(?:[^#]*&)?v=|shorts/|embed/|v/)([A-Za-z0-9_-]{11})") + ", " + _ex(r"https?://youtu\.be/([A-Za-z0-9_-]{11})") + ", " + _ex(_YT + r"clip/([A-Za-z0-9_-]+)") + ")"
_SQL_HANDLE, _SQL_CHANNEL, _SQL_LIST = _ex(_YT + r"(@[A-Za-z0-9._-]+)"), "coalesce(" + _ex(_YT + r"channel/(UC[A-Za-z0-9_-]{22}[A-Za-z0-9._-]*)") + ", " + _ex(_YT + r"(?:c|user)/([A-Za-z0-9._-]+)") + ")", _ex(_YT + r"playlist\?(?:[^#]*&)?list=([A-Za-z0-9_-]+)")
_SQL_MUSIC = "regexp_matches(url, 'https?://music\\.youtube\\.com/', 'i')"
_RES = "('" + "','".join(u.CODE_RESERVED) + "')"
_CP = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^https?://(?:www\\.)?github\\.com/', '', 'i'), '[?#].*$', ''), '/+$', ''), '^([^/]+/[^/]+?)\\.git(/|$)', '\\1\\2')"
_SEG = f"string_split({_CP}, '/')"
_CODE_ARG, _CODE_TAIL = f"{_SEG}[4]", f"nullif(array_to_string(list_slice({_SEG}, 5, 100), '/'), '')"
_SQL_CODE = f"""CASE WHEN regexp_matches(url, '^https?://raw\\.githubusercontent\\.com/[^/]+/[^/]+/[^/]+/[^?#]+', 'i') THEN 'blob'
 WHEN regexp_matches(url, '^https?://gist\\.github\\.com/(?:[^/]+/)?[0-9a-f]+', 'i') THEN 'gist'
 WHEN NOT regexp_matches(url, '^https?://(?:www\\.)?github\\.com/[^/?#]+', 'i') THEN NULL
 WHEN len({_SEG}) = 1 AND lower({_SEG}[1]) NOT IN {_RES} THEN 'org'
 WHEN {_SEG}[1] IN {_RES} THEN NULL WHEN len({_SEG}) = 2 THEN 'repo'
 WHEN {_SEG}[3] = 'blob' AND {_CODE_TAIL} IS NOT NULL THEN 'blob' WHEN {_SEG}[3] = 'tree' AND {_CODE_ARG} IS NOT NULL THEN 'tree'
 WHEN {_SEG}[3] = 'issues' AND regexp_matches({_CODE_ARG}, '^\\d+$') THEN 'issue' WHEN {_SEG}[3] = 'pull' AND regexp_matches({_CODE_ARG}, '^\\d+$') THEN 'pull'
 WHEN {_SEG}[3] = 'wiki' THEN 'wiki' WHEN {_SEG}[3] = 'commit' AND regexp_matches({_CODE_ARG}, '^[0-9a-fA-F]+$') THEN 'commit' WHEN {_SEG}[3] = 'compare' AND {_CODE_ARG} IS NOT NULL THEN 'compare'
 WHEN {_SEG}[3] = 'blame' AND {_CODE_TAIL} IS NOT NULL THEN 'blame' WHEN {_SEG}[3] = 'releases' THEN 'releases' WHEN {_SEG}[3] IN ('actions', 'projects') THEN {_SEG}[3] END"""
_HS = f"list_filter(string_split(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '/'), lambda s: s <> '')"
_HREST = f"array_to_string(list_slice({_HS}, 3, 50), '/')"
_HRES = "('" + "','".join(u.HUB_RESERVED) + "')"
_SQL_HUB = f"""CASE WHEN url IS NULL OR NOT regexp_matches(trim(url), '^https?://(?:www\\.)?huggingface\\.co(?:/.*)?$', 'i') OR len({_HS}) = 0 THEN NULL
 WHEN lower({_HS}[1]) IN ('datasets', 'spaces') THEN CASE WHEN len({_HS}) >= 2 THEN CASE WHEN lower({_HS}[1]) = 'datasets' THEN 'dataset' ELSE 'space' END END
 WHEN lower({_HS}[1]) IN {_HRES} THEN NULL WHEN len({_HS}) = 1 THEN 'org' WHEN regexp_matches({_HREST}, '^commit/[0-9a-f]{{7,40}}$', 'i') THEN 'commit'
 WHEN regexp_matches({_HREST}, '^tree/[^/]+') THEN 'tree' WHEN regexp_matches({_HREST}, '^(?:blob|resolve|raw)/[^/]+/.+') THEN 'file' ELSE 'model' END"""
_SQL_TOPIC = _ex(_TOPIC, 1, _PATH, "")

_COLUMNS = {
    "f1_arxiv": {"paper": (lambda c: u.arxiv_id(c), _SQL_ARXIV), "html": (lambda c: u.arxiv_html_id(c), _ex(r"https?://(?:export\.)?arxiv\.org/html/(\d{4}\.\d{4,5}(?:v\d+)?)"))},
    "f2_version": {"bare": (lambda c: u.without_version(u.arxiv_id(c)), f"regexp_replace({_SQL_ARXIV}, 'v\\d+$', '')")},
    "f3_doi": {"doi": (lambda c: u.doi(c), _SQL_DOI)},
    "f4_paper_hash": {"paper": (lambda c: u.paper_hash(c), _SQL_PAPER)},
    "f5_ietf": {"rfc": (lambda c: u.rfc_number(c), f"CAST({_SQL_RFC} AS BIGINT)"), "draft": (lambda c: u.draft_name(c), _SQL_DRAFT)},
    "f6_reddit": {
        "kind": (lambda c: u.reddit_kind(c), _SQL_REDDIT),
        "comment": (lambda c: u.reddit_comment(c), _ex(r"^/r/[^/]+/comments/\w+/[^/]+/(\w+)/?$", 1, _PATH)),
        "canonical": (lambda c: u.reddit_canonical(c), f"CASE WHEN ({_SQL_REDDIT}) IS NULL THEN NULL WHEN ({_SQL_REDDIT}) = 'short_link' THEN url WHEN ({_SQL_REDDIT}) <> 'search' THEN 'https://old.reddit.com' || regexp_replace(regexp_replace({_PATH}, '\\.json$', ''), '/?$', '/') || coalesce('?sort=' || " + _ex(r"[?&]sort=([^&#]+)", 1, "url", "") + ", '') END"),
    },
    "f7_hub": {"kind": (lambda c: u.hub_match(c)["kind"], _SQL_HUB), "repo": (lambda c: u.hub_match(c)["repo"], f"CASE WHEN ({_SQL_HUB}) IS NULL THEN NULL WHEN lower({_HS}[1]) IN ('datasets', 'spaces') THEN array_to_string(list_slice({_HS}, 2, 3), '/') WHEN len({_HS}) >= 2 THEN {_HS}[1] || '/' || {_HS}[2] ELSE '' END")},
    "f8_code": {"kind": (lambda c: u.code_match(c)["kind"], _SQL_CODE), "number": (lambda c: u.code_match(c)["number"], f"CASE WHEN ({_SQL_CODE}) IN ('issue', 'pull') THEN CAST({_CODE_ARG} AS BIGINT) END")},
    "f9_video": {"kind": (lambda c: u.video_match(c)["kind"], f"CASE WHEN {_SQL_MUSIC} THEN 'music' WHEN {_SQL_VIDEO} IS NOT NULL THEN 'video' WHEN coalesce({_SQL_HANDLE}, {_SQL_CHANNEL}) IS NOT NULL THEN 'channel' WHEN {_SQL_LIST} IS NOT NULL THEN 'playlist' END"), "ident": (lambda c: u.video_match(c)["id"], f"CASE WHEN {_SQL_MUSIC} THEN url ELSE coalesce({_SQL_VIDEO}, {_SQL_HANDLE}, {_SQL_CHANNEL}, {_SQL_LIST}) END")},
    "f10_forum": {"topic": (lambda c: u.topic_id(c), f"CAST({_SQL_TOPIC} AS BIGINT)"), "base": (lambda c: u.forum_base(c), f"regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '{_TOPIC}', ''), '/+$', '')")},
    "f11_scheme": {"allowed": (lambda c: u.scheme_allowed(c), "coalesce(lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('http', 'https'), false)")},
    "x29_fragment": {"fragment": (lambda c: u.fragment(c), "nullif(CASE WHEN instr(url, '#') > 0 THEN regexp_replace(url, '^[^#]*#', '') END, '')")},
    "p3_route": {},
}
# the ordered chain of sources
_ROUTE_SQL = f"CASE WHEN {_SQL_ARXIV} IS NOT NULL THEN 'arxiv' WHEN {_SQL_PAPER} IS NOT NULL THEN 'paper' WHEN {_SQL_RFC} IS NOT NULL OR ({_SQL_DRAFT}) IS NOT NULL THEN 'ietf' WHEN {_SQL_DOI} IS NOT NULL THEN 'doi' WHEN ({_SQL_REDDIT}) IS NOT NULL THEN 'reddit' WHEN ({_SQL_CODE}) IS NOT NULL THEN 'code' WHEN ({_SQL_HUB}) IS NOT NULL THEN 'hub' WHEN {_SQL_MUSIC} OR coalesce({_SQL_VIDEO}, {_SQL_HANDLE}, {_SQL_CHANNEL}, {_SQL_LIST}) IS NOT NULL THEN 'video' WHEN {_SQL_TOPIC} IS NOT NULL THEN 'forum' ELSE 'generic' END"
_COLUMNS.pop("p3_route")
_COLUMNS["route_chain"] = {"route": (lambda c: u.route(c), _ROUTE_SQL)}

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name, _cols in _COLUMNS.items():
    QUERIES[_name] = lambda spark, d, cols=_cols: _urls(spark, d).select("id", *[f(F.col("url")).alias(k) for k, (f, _) in cols.items()])
    SQL[_name] = "SELECT id, " + ", ".join(f"{s} AS {k}" for k, (_, s) in _cols.items()) + f" FROM {_URL_SQL}"


def _over(name: str, rows: list[tuple], ddl: str, columns: dict) -> None:
    """A query over inline rows: columns are name -> (Column, SQL)."""
    names = [p.split()[0] for p in ddl.split(", ")]
    QUERIES[name] = lambda spark, d: inline(spark, rows, ddl).select("id", *[c().alias(k) for k, (c, _) in columns.items()])
    SQL[name] = "SELECT id, " + ", ".join(f"{s} AS {k}" for k, (_, s) in columns.items()) + " FROM (" + values(rows, *names) + ")"


_over("x10_slug", [(1, "Hello, World!"), (2, "  13.2 Tree -- construction  "), (3, "snake_case"), (4, ""), (5, None), (6, "Über uns")], "id long, v string", {"slug": (lambda: tx.slug(F.col("v")), "trim(regexp_replace(lower(v), '[^a-z0-9]+', '-', 'g'), '-')")})
_over("x11_section_number", [(1, "13.2.6 Tree construction"), (2, "15\\. Security"), (3, "2024 in review"), (4, "No number"), (5, None), (6, "8.4.1.1. Deep")], "id long, v string", {"name": (lambda: tx.without_number(F.col("v")), "regexp_replace(v, '^\\d+(?:\\.\\d+)*(?:\\\\?\\.)?\\s+', '')")})
_over("h9_spaces", [(1, "a\u00a0b\u2003c\u200bd"), (2, "plain"), (3, None), (4, "\ufeffx\u3000y")], "id long, v string", {"text": (lambda: tx.plain_spaces(F.col("v")), "regexp_replace(v, '[\\x{00A0}\\x{2000}-\\x{200B}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]', ' ', 'g')")})
_over("h8_heading_text", [(1, "Real **Heading**"), (2, "[](#intro)Intro"), (3, "![logo](x.png) Title `code`"), (4, "[a](u\\(b\\)) c"), (5, None)], "id long, v string", {"text": (lambda: tx.heading_text(F.col("v")), "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '!\\[([^\\]]*)\\]\\((?:\\\\[()]|[^()])*\\)', '\\1', 'g'), '\\[([^\\]]*)\\]\\((?:\\\\[()]|[^()])*\\)', '\\1', 'g'), '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '`([^`]+)`', '\\1', 'g'))")})
_over("h16_card_header", [(1, "---\nlicense: mit\n---\n# Card\n---\nx"), (2, "# None\n---\n"), (3, None), (4, "---\na\n---\n---\nb\n---\n")], "id long, v string", {"card": (lambda: tx.without_card_header(F.col("v")), "regexp_replace(v, '^(?s:---\\n.*?\\n---\\n)', '')")})
_over("s4_content_class", [(1, "text/html; charset=utf-8"), (2, "application/json"), (3, "application/xml"), (4, "text/plain"), (5, "image/png"), (6, None), (7, "application/xhtml+xml")], "id long, v string", {"kind": (lambda: tx.content_class(F.col("v")), "CASE WHEN regexp_matches(v, 'text/html|application/xhtml') THEN 'html' WHEN regexp_matches(v, '(?:application|text)/json') THEN 'json' WHEN regexp_matches(v, '(?:application|text)/xml') THEN 'xml' WHEN contains(v, 'text/plain') THEN 'plain text' END")})
_over("s7_snippet", [(1, 'a <span class="searchmatch">hit</span> &amp; <b>b</b>'), (2, "&quot;x&quot; &lt;y&gt;"), (3, None)], "id long, v string", {"text": (lambda: tx.bold_snippet(F.col("v")), "replace(replace(replace(replace(replace(regexp_replace(regexp_replace(v, '<span class=\"searchmatch\">([^<]*)</span>', '**\\1**', 'g'), '<[^>]+>', '', 'g'), '&quot;', '\"'), '&#039;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')")})
_over("h14_forum_post", [(1, '[quote="ann, post:3, topic:9"]\nhello\n[/quote]\nreply'), (2, "![x|690x388](upload://abc.png) text"), (3, "![pic|200](https://a.test/b.png)"), (4, '[quote="bob"]\nhi[/quote]'), (5, None)], "id long, v string", {"text": (lambda: tx.clean_forum_post(F.col("v")), "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '\\[quote=\"([^,\"\\]]+)(?:,[^\"\\]]*?)?,\\s*post:(\\d+)[^\"\\]]*\"\\]\\s*', E'> **@\\\\1** (post #\\\\2):\\n> ', 'g'), '\\[quote=\"([^,\"\\]]+)[^\"\\]]*\"\\]\\s*', E'> **@\\\\1**:\\n> ', 'g'), '\\[/quote\\]\\s*', E'\\n', 'g'), '!\\[[^\\]]*\\]\\(upload://[^)]*\\)', '[image]', 'g'), '\\|(?:\\d+x\\d+|\\d+)(?:, \\d+%)?\\]', ']', 'g'))")})
_N = [(i, v) for i, v in enumerate([None, 0, 7, 59, 60, 3599, 3600, 3661, 86399, 360000])]
_two = lambda e: f"lpad(CAST({e} AS VARCHAR), 2, '0')"
_over("f26_clock", _N, "id long, v long", {
    "mmss": (lambda: tx.clock(F.col("v")), f"CASE WHEN v // 3600 > 0 THEN CASE WHEN v // 3600 < 100 THEN {_two('v // 3600')} ELSE CAST(v // 3600 AS VARCHAR) END || ':' || {_two('(v % 3600) // 60')} || ':' || {_two('v % 60')} ELSE {_two('(v % 3600) // 60')} || ':' || {_two('v % 60')} END"),
    "dur": (lambda: tx.duration(F.col("v")), f"CASE WHEN v // 3600 > 0 THEN CAST(v // 3600 AS VARCHAR) || ':' || {_two('(v % 3600) // 60')} || ':' || {_two('v % 60')} ELSE CAST((v % 3600) // 60 AS VARCHAR) || ':' || {_two('v % 60')} END"),
})
_over("f26_upload_date", [(1, "20240102"), (2, "2024"), (3, None), (4, "2024010x")], "id long, v string", {"day": (lambda: tx.upload_date(F.col("v")), "CASE WHEN regexp_matches(v, '^\\d{8}$') THEN substr(v, 1, 4) || '-' || substr(v, 5, 2) || '-' || substr(v, 7, 2) ELSE v END")})
_over("f27_severity", [(1, 9.8), (2, 7.0), (3, 4.0), (4, 0.1), (5, 0.0), (6, None)], "id long, v double", {"band": (lambda: tx.severity(F.col("v")), "CASE WHEN v >= 9 THEN 'Critical' WHEN v >= 7 THEN 'High' WHEN v >= 4 THEN 'Medium' WHEN v > 0 THEN 'Low' WHEN v IS NOT NULL THEN 'None' END")})
_over("f28_doi_rank", [(1, "10.1000/x"), (2, "10.1101/x"), (3, "10.48550/arXiv.1"), (4, "github:a/b"), (5, None)], "id long, v string", {"rank": (lambda: tx.doi_rank(F.col("v")), "CASE WHEN starts_with(v, '10.48550/arXiv.') THEN 0 WHEN starts_with(v, '10.1101/') THEN 1 WHEN v IS NOT NULL THEN 2 END")})
_over("f14_repo_number", [(1, "apache/spark#42"), (2, "apache/spark"), (3, None), (4, "a/b#x")], "id long, v string", {"owner": (lambda: tx.repo_number(F.col("v"))["owner"], "nullif(regexp_extract(v, '^([^/\\s]+)/([^/#\\s]+)#(\\d+)$', 1), '')"), "number": (lambda: tx.repo_number(F.col("v"))["number"], "TRY_CAST(nullif(regexp_extract(v, '^([^/\\s]+)/([^/#\\s]+)#(\\d+)$', 3), '') AS BIGINT)")})
_eco = "CASE " + " ".join(f"WHEN lower(regexp_extract(v, '^([^/]+)/', 1)) = '{k}' THEN '{s}'" for k, s in tx.ECOSYSTEMS.items()) + " END"
_rest = "regexp_replace(v, '^[^/]+/', '')"
_over("f15_package", [(1, "npm/@scope/name@1.2.3"), (2, "pip/requests"), (3, "crates/serde@"), (4, "zzz/x@1"), (5, "rust/tokio@1.0")], "id long, v string", {
    "system": (lambda: tx.package_query(F.col("v"))["system"], _eco),
    "name": (lambda: tx.package_query(F.col("v"))["name"], f"CASE WHEN regexp_matches({_rest}, '^(.+)@([^@]*)$') THEN regexp_extract({_rest}, '^(.+)@([^@]*)$', 1) ELSE {_rest} END"),
    "version": (lambda: tx.package_query(F.col("v"))["version"], f"nullif(regexp_extract({_rest}, '^(.+)@([^@]*)$', 2), '')"),
})
_over("f16_repo_rev", [(1, "org/model@v2"), (2, "org/model"), (3, None), (4, "org/m@")], "id long, v string", {"repo": (lambda: tx.repo_rev(F.col("v"))["repo"], "split_part(v, '@', 1)"), "rev": (lambda: F.when(F.col("v").isNotNull(), tx.repo_rev(F.col("v"))["rev"]), "CASE WHEN v IS NOT NULL THEN coalesce(nullif(split_part(v, '@', 2), ''), 'main') END")})
_over("f18_family_stem", [(1, "org/Model-7B-GGUF"), (2, "Model-7B-awq-4bit"), (3, "-gguf"), (4, "Plain"), (5, None), (6, "MiMo-LM-MLX-Q9"), (7, "m-q4_k_m")], "id long, v string", {"stem": (lambda: tx.family_stem(F.col("v")), "CASE WHEN v = '-gguf' THEN v ELSE regexp_replace(list_last(string_split(v, '/')), '(?i)(?:[-_.](?:" + tx.CONVERSIONS + "))+$', '') END")})
_over("f12_wiki_title", [(1, "main page"), (2, "éclair du jour"), (3, " x "), (4, None)], "id long, v string", {"title": (lambda: u.wiki_title(F.col("v")), "upper(left(replace(trim(v), ' ', '_'), 1)) || substr(replace(trim(v), ' ', '_'), 2)")})
_over("f13_percent", [(1, "a b/c"), (2, "x~y.z-1_"), (3, None), (4, "+&=")], "id long, v string", {"enc": (lambda: u.percent_encoded(F.col("v")), "replace(url_encode(v), '+', '%20')")})
_over("f29_human", [(1, 512), (2, 2048), (3, 5_500_000), (4, 7_200_000_000), (5, 1_500_000_000_000), (6, None), (7, 0), (8, 1280)], "id long, v long", {
    "size": (lambda: tx.human_bytes(F.col("v")), "CASE WHEN v >= 1073741824 THEN printf('%.2f GiB', v / 1073741824.0) WHEN v >= 1048576 THEN printf('%.1f MiB', v / 1048576.0) WHEN v > 0 THEN format('{:,}', v) || ' B' END"),
    "params": (lambda: tx.human_count(F.col("v")), "CASE WHEN v >= 1e9 THEN printf('%.1fB', v / 1e9) WHEN v >= 1e6 THEN printf('%.1fM', v / 1e6) WHEN v > 0 THEN format('{:,}', v) END"),
    "logged": (lambda: F.when(F.col("v").isNotNull(), tx.log_bytes(F.col("v"))), "CASE WHEN v < 1024 THEN CAST(v AS VARCHAR) || ' B' WHEN v < 1048576 THEN printf('%.1f KB', v / 1024.0) WHEN v IS NOT NULL THEN printf('%.1f MB', v / 1048576.0) END"),
})
_over("r2_fence", [(1, "one\ntwo", "Title"), (2, "x", None), (3, "", "T")], "id long, v string, title string", {"text": (lambda: tx.fenced(F.col("v"), F.col("title")), "E'┌─ untrusted content\\n│\\n' || CASE WHEN title IS NOT NULL THEN '│ # ' || title || E'\\n│ \\n' ELSE '' END || array_to_string(list_transform(string_split(v, chr(10)), lambda x: '│ ' || x), chr(10)) || E'\\n│\\n└─ untrusted content'")})


def f23_partial_date(spark: SparkSession, d: str) -> DataFrame:
    rows = inline(spark, [(1, 2024, 3, 9), (2, 2024, 3, None), (3, 2024, None, None)], "id long, y long, m long, dd long")
    parts = F.filter(F.array("y", "m", "dd"), lambda x: x.isNotNull())
    return rows.select("id", tx.partial_date(parts).alias("day"))


def f24_event_time(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm 'UTC'").alias("shown"))


def f25_relative_age(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", tx.relative_age(F.col("ts").cast("timestamp"), F.lit("2025-01-01 00:00:00").cast("timestamp")).alias("age"))


QUERIES |= {"f23_partial_date": f23_partial_date, "f24_event_time": f24_event_time, "f25_relative_age": f25_relative_age}
_S = "(epoch(TIMESTAMP '2025-01-01 00:00:00') - floor(epoch(CAST(ts AS TIMESTAMP))))"
SQL |= {
    "f23_partial_date": "SELECT id, CASE WHEN dd IS NOT NULL THEN printf('%04d-%02d-%02d', y, m, dd) WHEN m IS NOT NULL THEN printf('%04d-%02d', y, m) ELSE printf('%04d', y) END AS day FROM (" + values([(1, 2024, 3, 9), (2, 2024, 3, None), (3, 2024, None, None)], "id", "y", "m", "dd") + ")",
    "f24_event_time": "SELECT event_id, strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M UTC') AS shown FROM events",
    "f25_relative_age": f"SELECT event_id, CASE WHEN {_S} < 60 THEN 'just now' WHEN {_S} < 3600 THEN CAST(CAST(floor({_S} / 60) AS BIGINT) AS VARCHAR) || 'm ago' WHEN {_S} < 86400 THEN CAST(CAST(floor({_S} / 3600) AS BIGINT) AS VARCHAR) || 'h ago' WHEN {_S} < 86400 * 30 THEN CAST(CAST(floor({_S} / 86400) AS BIGINT) AS VARCHAR) || 'd ago' WHEN {_S} < 86400 * 365 THEN CAST(CAST(floor({_S} / (86400 * 30)) AS BIGINT) AS VARCHAR) || 'mo ago' ELSE CAST(CAST(floor({_S} / (86400 * 365)) AS BIGINT) AS VARCHAR) || 'y ago' END AS age FROM events",
}
