import pytest

from sheaf.api import Engine

TEXT = "# Guide\nIntro about rivers.\n## Setup\nInstall the harbour tool.\n### Details\nDeep harbour.\n## Use\nRun it.\n"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, None), (3, "plain rivers")], "id long, t string")


def test_contents(engine, docs):
    assert [r.line for r in engine.contents(docs, "id", "t").orderBy("idx").collect()] == ["- Guide", "  - Setup", "    - Details", "  - Use"]


def test_sections(engine, docs):
    rows = {r.req: r.text for r in engine.section(docs.where("id = 1"), "id", "t", ["setup", "None"]).collect()}
    assert rows == {"setup": "## Setup\nInstall the harbour tool.", "None": None}
    assert "Deep harbour" in engine.section(docs.where("id = 1"), "id", "t", ["Setup"], expand=True).first().text


def test_search(engine, docs):
    assert [r.id for r in engine.search(docs, "id", "t", "rivers").collect()] == [3, 1]
    assert [(r.id, r.idx) for r in engine.search_pages(docs, "id", "t", "harbour").collect()] == [(1, 0)]


def test_slices(engine, docs):
    assert [(r.id, r.idx, r.ancestry) for r in engine.slices(docs, "id", "t", [0, 9]).orderBy("id").collect()] == [(1, 0, "Guide"), (3, 0, "")]


def test_routes(engine, spark):
    df = spark.createDataFrame([("https://doi.org/10.1/x",), ("https://a.test/b#sec",)], "url string")
    assert [(r.route, r.fragment) for r in engine.route(df).collect()] == [("doi", None), ("generic", "sec")]


def test_transcripts(engine, spark):
    s = spark.createDataFrame([("v", 0.0, 20.0, "one river"), ("v", 20.0, 14.0, "two"), ("v", 40.0, 5.0, "three river")], "video string, start double, duration double, text string")
    assert [(r.win, r.start) for r in engine.transcript(s, "video", "river", start=35.0).collect()] == [(1, 40.0)]


def test_export_forms(engine):
    with pytest.raises(ValueError):
        engine.export(None, "odd")
