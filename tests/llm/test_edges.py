"""Nulls in any column, empty tables, repeated rows, clashing extra columns, very long texts."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm import codedocs, leaks, names, pages, papers, runs, sections, tokens, truncation, turns

SEG = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("duration", T.DoubleType()), T.StructField("text", T.StringType())])
SCHEMAS = {
    "documents": "doc_id long, url string, site string, title string, text string, lang string, source string, n_chars int, renderer string, fetched_at timestamp",
    "sections": "doc_id long, section_no int, name string, level int, start_pos int, end_pos int, header_only boolean, extracted_at timestamp",
    "citation_records": "record_id long, doi string, title string, authors array<string>, year int, venue string, alt_dois array<string>, source_tool string, bibtex string, orcids map<string,string>, added string, score int, confirmed boolean, notes string, retraction struct<notice_doi:string,date:string,source:string,label:string>",
    "captions": "video_id string, seg_idx int, start double, duration double, text string, language_code string, is_generated boolean, fetched_at timestamp",
    "windows": "video_id string, win_idx int, start double, end_time double, segments array<struct<start:double,duration:double,text:string>>",
    "chapters": "video_id string, start_time double, end_time double, title string",
    "source_files": "file_id long, repo string, path string, ext string, source string, fetched_at timestamp",
    "fetch_responses": "fetch_id long, url string, status_code int, headers map<string,string>, content binary, http_version string, remote_addr string, history array<string>, pinned boolean, fetched_at timestamp",
    "eval_items": "item_id long, suite string, lang string, passage string, question string, answer string",
}
OPERATORS = {
    "p1": (lambda t: sections.split_sections(t["documents"], t["sections"]), ["documents", "sections"]),
    "p2": (lambda t: papers.merged_papers(t["citation_records"]), ["citation_records"]),
    "p2_found": (lambda t: papers.found(t["citation_records"]), ["citation_records"]),
    "p3": (lambda t: runs.cue_runs(t["captions"], ["video_id"], "seg_idx"), ["captions"]),
    "p3_windows": (lambda t: runs.window_runs(t["windows"]), ["windows"]),
    "p4": (lambda t: names.found(t["citation_records"]), ["citation_records"]),
    "p5": (lambda t: codedocs.documented_functions(t["source_files"]), ["source_files"]),
    "p6": (lambda t: pages.main_bodies(t["fetch_responses"]), ["fetch_responses"]),
    "p7": (lambda t: turns.speaker_turns(t["captions"], t["chapters"]), ["captions", "chapters"]),
    "p8": (lambda t: tokens.encode(t["documents"]), ["documents"]),
    "p9": (lambda t: leaks.leaks(t["documents"], t["eval_items"]), ["documents", "eval_items"]),
    "p10": (lambda t: truncation.truncated(t["documents"]), ["documents"]),
    "p10_rates": (lambda t: truncation.truncation_rates(t["documents"]), ["documents"]),
}

WORDS = "a bounded river that feeds seven harbours was opened near the quiet archive by twelve readers before noon today".split()


def sample(name):
    text = " ".join(WORDS)
    long = (text + ". ") * 1500
    rows = {
        "documents": [(1, "u", "s", "t", long, "en", "web", 5, None, None), (2, None, None, None, "", None, None, None, None, None), (3, "u", "s", "t", "x" * 60_000, "en", "web", 5, None, None), (4, "u", "s", "t", text.capitalize() + ".", "en", "web", 5, None, None), (4, "u", "s", "t", text.capitalize() + ".", "en", "web", 5, None, None)],
        "sections": [(1, 1, "n", 1, 0, None, None, None), (1, 1, "n", 1, 0, None, None, None), (1, 2, "n", None, 50, 10**6, None, None), (3, 1, "n", 2, -4, 99_999, None, None), (9, 1, "n", 2, 0, 5000, None, None), (2, 1, "n", 2, 7, 5000, None, None)],
        "citation_records": [(1, "10.1234/A.", "On Rivers: a study", ["Sato, Ana", "Müller, Jörg"], 2020, "J. Riv.", ["10.48550/arXiv.1"], None, None, {"Sato, Ana": "0000-0002-1825-0097"}, None, None, None, None, None), (2, "doi:10.1234/a", "on rivers", ["Ana Sato", None, ""], None, "Journal of Rivers", None, None, None, None, None, None, None, None, None), (2, "doi:10.1234/a", "on rivers", ["Ana Sato", None, ""], None, "Journal of Rivers", None, None, None, None, None, None, None, None, None), (3, None, None, None, None, None, None, None, None, None, None, None, None, None, None), (4, "nonsense", "", [], None, "", [None], None, None, {}, None, None, None, None, None)],
        "captions": [("v", i, float(i), 1.0, t, "en", True, None) for i, t in enumerate(["one two", "One, two!", None, "one two", "", "Ann Poe: hello there", "Bob Orr: well hello", "A. Poe: again " + "word " * 5000])] + [("v", 0, 0.0, 1.0, "one two", "en", True, None), (None, 1, None, None, "x", None, None, None), ("w", None, None, None, "x", None, None, None)],
        "windows": [("v", 0, 0.0, 2.0, [(0.0, 1.0, "a b"), (1.0, 1.0, "a b")]), ("v", 1, 2.0, 3.0, [(2.0, None, "A b.")]), ("v", 2, None, None, None), ("v", 3, None, None, [])],
        "chapters": [("v", 0.0, 9.0, "Q&A with Ann Poe"), ("v", None, None, None), (None, None, None, None)],
        "source_files": [(1, "r", "a.py", None, 'def f(x):\n    """Adds seven to a number."""\n    return x + 7\n', None), (1, "r", "a.py", None, 'def f(x):\n    """Adds seven to a number."""\n    return x + 7\n', None), (2, None, None, None, "x", None), (3, "r", "b.js", "js", None, None), (4, "r", "c.go", "go", "", None), (5, "r", "d.js", "js", "/** Opens " + "(" * 3000 + " */\nfunction g() {" + "{" * 500, None)],
        "fetch_responses": [(1, "http://h/a", 200, {"Content-Type": "text/html; charset=nope"}, bytearray(b"<html><body><main><p>" + text.encode() + b".</p></main><footer><p>\xff footer</p></footer></body>"), None, None, None, None, None), (1, "http://h/a", 200, {"Content-Type": "text/html"}, bytearray(b"<p>x</p>"), None, None, None, None, None), (2, None, 200, None, bytearray(b""), None, None, None, None, None), (3, "u", 404, None, bytearray(b"<p>gone</p>"), None, None, None, None, None), (4, "u", 200, {}, None, None, None, None, None, None), (5, "u", 200, {}, bytearray(b"<div>" * 3000 + b"deep"), None, None, None, None, None)],
        "eval_items": [(1, "s", "en", text, None, None), (1, "s", "en", text, None, None), (2, "s", "en", text, None, None), (3, "s", "en", None, None, None), (4, "s", "en", "too short", None, None)],
    }[name]
    return rows


def frame(spark, name, rows):
    return spark.createDataFrame(rows, SCHEMAS[name])


@pytest.mark.parametrize("op", OPERATORS)
def test_empty_tables(spark, op):
    run, tables = OPERATORS[op]
    assert run({t: frame(spark, t, []) for t in tables}).collect() == []


@pytest.mark.parametrize("op", OPERATORS)
def test_nulls_in_every_column(spark, op):
    run, tables = OPERATORS[op]
    random.seed(7)
    holes = {}
    for t in tables:
        rows = sample(t)
        width = len(rows[0])
        holed = [tuple(None if i == k else v for i, v in enumerate(r)) for r in rows for k in range(width)]
        holes[t] = frame(spark, t, [*rows, *holed, (None,) * width])
    run(holes).collect()


@pytest.mark.parametrize("op", OPERATORS)
def test_extra_columns_and_repeated_rows_change_nothing(spark, op):
    run, tables = OPERATORS[op]
    plain = {t: frame(spark, t, sample(t)) for t in tables}
    clash = {}
    for t in tables:
        df = plain[t]
        for c in ("key", "n", "label", "q", "name", "value", "weight", "component", "cluster", "text", "kind", "g", "p", "id"):
            if c not in df.columns:
                df = df.withColumn(c, F.lit("clash"))
        clash[t] = df
    rows = lambda d: sorted(map(str, run(d).collect()))
    assert rows(plain) == rows(clash)
