import os

import pytest
from pyspark.sql import functions as F

from sheaf.operators import code, wiki
from sheaf.plans.extra import WIKI
from tests.util import DATA


def test_python_definitions():
    source = 'class A:\n    """Doc.\n    more"""\n    def f(self):\n        def g(): pass\n\nasync def h():\n    pass\n'
    assert code.definitions(source, ".py") == [("class", "A", 1, 5, 0, "Doc."), ("function", "f", 4, 5, 1, None), ("function", "g", 5, 5, 2, None), ("function", "h", 7, 8, 0, None)]
    assert code.definitions("def (", "py") == [] and code.definitions("", "py") == [] and code.definitions("x", "zig") == []


def test_definitions_with_braces():
    source = 'export class A {\n  /** Runs. */\n  run(x) {\n    log("function no() {");\n  }\n}\n'
    assert code.definitions(source, "ts") == [("class", "A", 1, 6, 0, None), ("method", "run", 3, 5, 1, "Runs.")]
    assert code.definitions("// Opens.\nfunc (s *T) Run() error {\n}\n", "go") == [("method", "Run", 2, 3, 0, "Opens.")]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_the_functions_of_an_index_are_found(spark):
    files = spark.read.parquet(f"{DATA}/source_files.parquet").dropDuplicates(["file_id"])
    got = code.code_definitions(files, "file_id", F.regexp_extract("path", r"\.([A-Za-z]+)$", 1), "source")
    want = spark.read.parquet(f"{DATA}/code_definitions.parquet").where("kind IN ('function', 'method')").select("file_id", "name").distinct()
    missing = want.join(got.select("file_id", "name").distinct(), ["file_id", "name"], "left_anti").count()
    assert missing <= 0.1 * max(1, want.count())


def test_slices_join_to_the_source():
    source = "".join(f"def f{i}():\n    return {i}\n\n" for i in range(80)) + "x = 1\n"
    slices = code.code_slices(source, "py")
    assert "".join(s[2] for s in slices) == source and all(len(s[2]) <= 1000 for s in slices)


def test_wiki_markdown():
    text = wiki.wiki_markdown(WIKI)
    assert "[^1]" in text and "$x^2$" in text and "## Next" in text
    assert "toc" not in text and "links" not in text and "[edit]" not in text and "Bar" not in text


def test_wiki_pages_without_references():
    assert wiki.footnotes("<p>x</p>") == [] and wiki.footnotes(None) == [] and wiki.author_date_citations("<a href='#CITEREFNone'>x</a>") == []
