"""Sections, contents, slices and budgets over documents and the sections table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import structure as st
from sheaf.plans.fixtures import inline, values
from sheaf.sources.tables import latest, table


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """Sections as the table has them, each once, those with a level."""
    s = latest(table(spark, d, "sections"), ["doc_id", "section_no"], "extracted_at", ["name", "level", "start_pos", "end_pos", "header_only"])
    return s.where("level IS NOT NULL").withColumnRenamed("section_no", "idx")


_TREE = "(SELECT doc_id, section_no AS idx, max(name) AS name, max(level) AS level, max(start_pos) AS start_pos, max(end_pos) AS end_pos, bool_or(header_only) AS header_only FROM sections WHERE level IS NOT NULL GROUP BY doc_id, section_no)"
_LINES = "(SELECT doc_id, n, line, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 1 AS BIGINT) AS off FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL))"
_RANGES = f"""lines AS (SELECT * FROM {_LINES}),
marks AS (SELECT doc_id, off, regexp_extract(line, '^(`{{3,}}|~{{3,}})', 1) AS mk, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM lines WHERE regexp_matches(line, '^(`{{3,}}|~{{3,}})')),
walk AS (
  SELECT doc_id, k, mk AS open_mk, off AS open_off, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM marks WHERE k = 1
  UNION ALL
  SELECT m.doc_id, m.k, CASE WHEN w.open_mk IS NULL THEN m.mk WHEN left(m.mk, 1) = left(w.open_mk, 1) AND length(m.mk) >= length(w.open_mk) THEN NULL ELSE w.open_mk END,
    CASE WHEN w.open_mk IS NULL THEN m.off ELSE w.open_off END,
    CASE WHEN w.open_mk IS NOT NULL AND left(m.mk, 1) = left(w.open_mk, 1) AND length(m.mk) >= length(w.open_mk) THEN w.open_off END,
    CASE WHEN w.open_mk IS NOT NULL AND left(m.mk, 1) = left(w.open_mk, 1) AND length(m.mk) >= length(w.open_mk) THEN m.off + length(m.mk) END
  FROM walk w JOIN marks m ON m.doc_id = w.doc_id AND m.k = w.k + 1),
ranges AS (SELECT doc_id, a, b FROM walk WHERE a IS NOT NULL)"""
_FOUND = f"""{_RANGES},
heads AS (SELECT l.doc_id, l.n, l.off, length(regexp_extract(line, '^(#{{1,6}})', 1)) AS level, trim(regexp_replace(regexp_extract(line, '^#{{1,6}}\\s+(.+)$', 1), '[\\x{{00A0}}\\x{{2000}}-\\x{{200B}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]', ' ', 'g')) AS name
  FROM lines l WHERE regexp_matches(line, '^#{{1,6}}\\s+.+$') AND NOT EXISTS (SELECT 1 FROM ranges r WHERE r.doc_id = l.doc_id AND r.a <= l.off AND l.off < r.b)),
secs AS (SELECT h.doc_id, row_number() OVER w - 1 AS idx, name, level, off AS start_pos, coalesce(lead(off) OVER w, length(d.text)) AS end_pos FROM heads h JOIN documents d USING (doc_id) WHERE length(name) > 1 WINDOW w AS (PARTITION BY h.doc_id ORDER BY off))"""


def x1_fences(spark: SparkSession, d: str) -> DataFrame:
    import pyarrow as pa

    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    return table(spark, d, "documents").select("doc_id", "text").mapInArrow(st._rows(st.fenced_ranges, schema), "doc_id long, a long, b long")


def x2_sections(spark: SparkSession, d: str) -> DataFrame:
    return st.sections(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "idx", "name", "level", "start_pos", "end_pos")


def x3_parent(spark: SparkSession, d: str) -> DataFrame:
    return st.with_parents(_tree(spark, d), "doc_id", "idx").select("doc_id", "idx", "parent")


def x4_subtree(spark: SparkSession, d: str) -> DataFrame:
    s = _tree(spark, d).where("start_pos IS NOT NULL AND end_pos IS NOT NULL")
    return st.with_subtree_end(s, "doc_id", "idx").select("doc_id", "idx", "subtree_end")


def x5_name_counts(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).groupBy("doc_id", "name").agg(F.count("*").alias("n"))


def x6_contents(spark: SparkSession, d: str) -> DataFrame:
    return st.table_of_contents(_tree(spark, d), "doc_id", "idx").select("doc_id", "idx", "line")


def x8_ancestry_paths(spark: SparkSession, d: str) -> DataFrame:
    return st.with_ancestry(_tree(spark, d), "doc_id", "idx").select("doc_id", "idx", "ancestry")


_PAGES = [(i, t, r) for i, (t, r) in enumerate([(0, 0), (250, 0), (250, 2), (250, 3), (250, -1), (250, -3), (250, -4), (100, 1), (1, 0), (101, 9)])]


def x7_contents_page(spark: SparkSession, d: str) -> DataFrame:
    return inline(spark, _PAGES, "id long, total long, req long").select("id", st.contents_page(F.col("total"), F.col("req")).alias("p")).select("id", "p.*")


def x8_slice_ancestry(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return st.slice_ancestry(st.chunks(docs, "doc_id", "text", "lines"), st.sections(docs, "doc_id", "text"), "doc_id")


def x13_line_chunks(spark: SparkSession, d: str) -> DataFrame:
    return st.chunks(table(spark, d, "documents"), "doc_id", "text", "lines").select("doc_id", "idx", "off", F.length("text").alias("n"))


def x12_semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    return st.chunks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "idx", "off", F.length("text").alias("n"))


def x20_slices(spark: SparkSession, d: str) -> DataFrame:
    """Slices 0, 2 and 99 of each document; those that are not there come out as missing."""
    want = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.array(F.lit(0), F.lit(2), F.lit(99))).alias("idx"))
    return want.join(x13_line_chunks(spark, d).select("doc_id", "idx", "n"), ["doc_id", "idx"], "left").select("doc_id", "idx", "n", F.col("n").isNull().alias("missing"))


def x21_budget(spark: SparkSession, d: str) -> DataFrame:
    c = st.chunks(table(spark, d, "documents"), "doc_id", "text", "lines").withColumn("need", F.length("text") + 20)
    return st.within_budget(c, "doc_id", "idx", F.col("need"), 4000).groupBy("doc_id").agg(F.count("*").alias("kept"))


def x25_line_range(spark: SparkSession, d: str) -> DataFrame:
    return st.line_range(table(spark, d, "documents"), "doc_id", "text", 3, 5).select("doc_id", "line_no", F.length("line").alias("line_len"))


def x26_hard_cut(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", st.hard_cut(F.col("text"), 200).alias("c")).select("doc_id", F.length("c.shown").alias("shown_chars"), "c.hint")


_SECS = [(1, 0, "Guide", 1, 0, 50, False), (1, 1, "1. Overview", 2, 50, 60, True), (1, 2, "Details", 3, 60, 90, False), (1, 3, "History", 2, 90, 120, False), (1, 4, "Details", 3, 120, 150, False), (1, 5, "It's a_name", 2, 150, 160, False)]
_REQS = [(1, "Guide"), (1, "Overview"), (1, "Details"), (1, "Details (History)"), (1, "its-a-name"), (1, "it-s-a-name"), (1, "IT%27S_A_NAME"), (1, "history"), (1, "Nothing")]


def x9_filter(spark: SparkSession, d: str) -> DataFrame:
    secs = inline(spark, _SECS, "doc long, idx int, name string, level int, start_pos int, end_pos int, header_only boolean")
    return st.matched_sections(secs, inline(spark, _REQS, "doc long, req string"), "doc").select("req", "idx", "tier")


def j9_contained(spark: SparkSession, d: str) -> DataFrame:
    """Sections that lie inside another's subtree, with the innermost: subtrees nest, so it is the parent."""
    s = st.with_parents(_tree(spark, d).where("start_pos IS NOT NULL AND end_pos IS NOT NULL"), "doc_id", "idx")
    return s.where("parent IS NOT NULL").select("doc_id", "idx", F.col("parent").alias("inner_most"))


QUERIES = {f.__name__: f for f in (x1_fences, x2_sections, x3_parent, x4_subtree, x5_name_counts, x6_contents, x7_contents_page, x8_ancestry_paths, x8_slice_ancestry, x9_filter, x12_semantic_chunks, x13_line_chunks, x20_slices, x21_budget, x25_line_range, x26_hard_cut, j9_contained)}
_PARENT = f"(SELECT s.doc_id, s.idx, s.name, s.level, s.header_only, (SELECT max(p.idx) FROM {_TREE} p WHERE p.doc_id = s.doc_id AND p.idx < s.idx AND p.level < s.level) AS parent FROM {_TREE} s)"
_SUB = f"(SELECT s.doc_id, s.idx, s.start_pos, coalesce((SELECT min(p.start_pos) FROM t p WHERE p.doc_id = s.doc_id AND p.idx > s.idx AND p.level <= s.level), last_value(s.end_pos) OVER (PARTITION BY s.doc_id ORDER BY s.idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS subtree_end FROM t s)"
_PACK = f"""WITH RECURSIVE l AS (SELECT doc_id, n, off, length(line) + 1 AS len FROM {_LINES}),
q AS (SELECT doc_id, n, off, least(len, (SELECT length(text) FROM documents d WHERE d.doc_id = l.doc_id) - off) AS len FROM l),
r AS (SELECT * FROM q WHERE len > 0), k AS (SELECT doc_id, n, off, len, 0 AS idx, off AS start, len AS used FROM r WHERE n = 1
 UNION ALL SELECT r.doc_id, r.n, r.off, r.len, CASE WHEN k.used > 0 AND k.used + r.len > 1800 THEN k.idx + 1 ELSE k.idx END, CASE WHEN k.used > 0 AND k.used + r.len > 1800 THEN r.off ELSE k.start END, CASE WHEN k.used > 0 AND k.used + r.len > 1800 THEN r.len ELSE k.used + r.len END FROM k JOIN r ON r.doc_id = k.doc_id AND r.n = k.n + 1),
chunk AS (SELECT doc_id, idx, min(start) AS off, sum(len) AS n FROM k GROUP BY doc_id, idx)"""
SQL = {
    "x1_fences": f"WITH RECURSIVE {_RANGES} SELECT doc_id, a, b FROM ranges",
    "x2_sections": f"WITH RECURSIVE {_FOUND} SELECT doc_id, idx, name, level, start_pos, end_pos FROM secs",
    "x3_parent": f"SELECT doc_id, idx, parent FROM {_PARENT}",
    "x4_subtree": f"WITH t AS (SELECT * FROM {_TREE} WHERE start_pos IS NOT NULL AND end_pos IS NOT NULL) SELECT doc_id, idx, subtree_end FROM {_SUB}",
    "x5_name_counts": f"SELECT doc_id, name, count(*) AS n FROM {_TREE} GROUP BY doc_id, name",
    "x6_contents": f"WITH p AS (SELECT * FROM {_PARENT}) SELECT s.doc_id, s.idx, repeat('  ', CAST(s.level - min(s.level) OVER (PARTITION BY s.doc_id) AS BIGINT)) || '- ' || CASE WHEN count(*) OVER (PARTITION BY s.doc_id, s.name) > 1 AND q.name IS NOT NULL THEN s.name || ' (' || q.name || ')' ELSE s.name END || CASE WHEN s.header_only THEN ' [header only]' ELSE '' END AS line FROM p s LEFT JOIN p q ON q.doc_id = s.doc_id AND q.idx = s.parent",
    "x7_contents_page": "SELECT id, CASE WHEN total = 0 THEN 0 ELSE page * 100 END AS start, CASE WHEN total = 0 THEN 0 ELSE page END AS page, pages, CASE WHEN total > 0 AND NOT (real >= 0 AND real < pages) THEN req END AS clamped_from FROM (SELECT *, greatest(least(real, pages - 1), 0) AS page FROM (SELECT *, CASE WHEN req < 0 THEN pages + req ELSE req END AS real FROM (SELECT *, (total + 99) // 100 AS pages FROM (" + values(_PAGES, "id", "total", "req") + "))))",
    "x8_ancestry_paths": f"WITH RECURSIVE p AS (SELECT * FROM {_PARENT}), w AS (SELECT doc_id, idx, name AS ancestry, parent FROM p UNION ALL SELECT w.doc_id, w.idx, q.name || ' > ' || w.ancestry, q.parent FROM w JOIN p q ON q.doc_id = w.doc_id AND q.idx = w.parent) SELECT doc_id, idx, ancestry FROM w WHERE parent IS NULL",
    "x13_line_chunks": f"{_PACK} SELECT doc_id, idx, off, n FROM chunk",
    "x20_slices": f"{_PACK}, want AS (SELECT doc_id, unnest([0, 2, 99]) AS idx FROM documents WHERE text IS NOT NULL) SELECT w.doc_id, w.idx, c.n, c.n IS NULL AS missing FROM want w LEFT JOIN chunk c USING (doc_id, idx)",
    "x21_budget": f"{_PACK}, u AS (SELECT doc_id, idx, sum(n + 20) OVER (PARTITION BY doc_id ORDER BY idx) AS used FROM chunk) SELECT doc_id, count(*) AS kept FROM u WHERE idx = 0 OR NOT EXISTS (SELECT 1 FROM u v WHERE v.doc_id = u.doc_id AND v.idx <= u.idx AND v.idx > 0 AND v.used > 4000) GROUP BY doc_id",
    "x25_line_range": f"SELECT doc_id, n AS line_no, length(line) AS line_len FROM {_LINES} WHERE n BETWEEN 3 AND 5",
    "x26_hard_cut": "SELECT doc_id, length(left(text, 800)) AS shown_chars, CASE WHEN length(text) > 800 THEN 'Full page is ' || printf('%.1f', length(text) / 1024.0) || ' KB (~' || format('{:,}', length(text) // 4) || ' tokens), showing first ~200 tokens. Use max_tokens to adjust.' END AS hint FROM documents",
    "x9_filter": "SELECT * FROM (VALUES ('Guide', 0, 0), ('Overview', 1, 1), ('Details', 2, 1), ('Details (History)', 4, 0), ('its-a-name', NULL, NULL), ('it-s-a-name', 5, 2), ('IT%27S_A_NAME', 5, 3), ('history', 3, 2), ('Nothing', NULL, NULL)) AS t(req, idx, tier)",
    "j9_contained": f"WITH t AS (SELECT * FROM {_TREE} WHERE start_pos IS NOT NULL AND end_pos IS NOT NULL), s AS (SELECT * FROM {_SUB}) SELECT a.doc_id, a.idx, max(b.idx) AS inner_most FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.idx <> b.idx AND b.start_pos <= a.start_pos AND a.subtree_end <= b.subtree_end AND (b.start_pos < a.start_pos OR a.subtree_end < b.subtree_end) GROUP BY a.doc_id, a.idx",
    "x8_slice_ancestry": f"""{_PACK}, {_FOUND},
par AS (SELECT s.*, (SELECT max(p.idx) FROM secs p WHERE p.doc_id = s.doc_id AND p.idx < s.idx AND p.level < s.level) AS parent FROM secs s),
w AS (SELECT doc_id, idx, name AS path, parent FROM par UNION ALL SELECT w.doc_id, w.idx, q.name || ' > ' || w.path, q.parent FROM w JOIN par q ON q.doc_id = w.doc_id AND q.idx = w.parent),
path AS (SELECT doc_id, idx, path FROM w WHERE parent IS NULL),
near AS (SELECT c.doc_id, c.idx, s.idx AS sec FROM chunk c ASOF LEFT JOIN secs s ON s.doc_id = c.doc_id AND s.start_pos <= c.off)
SELECT a.doc_id, a.idx, CASE WHEN sec IS NULL THEN '' WHEN count(*) OVER (PARTITION BY a.doc_id, sec) > 1 THEN p.path || ' (' || row_number() OVER (PARTITION BY a.doc_id, sec ORDER BY a.idx) || '/' || count(*) OVER (PARTITION BY a.doc_id, sec) || ')' ELSE p.path END AS ancestry
FROM near a LEFT JOIN path p ON p.doc_id = a.doc_id AND p.idx = a.sec""",
}
