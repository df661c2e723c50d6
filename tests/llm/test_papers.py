import pytest
from pyspark.sql import functions as F

from sheaf.llm import papers
from tests.llm.test_edges import SCHEMAS


def rec(i, doi=None, title=None, authors=("Sato, Ana",), year=2020, venue=None, alts=None):
    return (i, doi, title, list(authors) if authors is not None else None, year, venue, alts, None, None, None, f"2024-01-{i:02d}", None, None, None, None)


def found(spark, rows):
    return {r.record_id: r.doi for r in papers.found(spark.createDataFrame(rows, SCHEMAS["citation_records"])).collect()}


@pytest.mark.parametrize("raw", ["10.1234/AbC.", "doi:10.1234/abc", "DOI: 10.1234/ABC", " 10.1234/abc ", "https://doi.org/10.1234/abc", "info:doi/10.1234/abc", "http://dx.doi.org/10.1234/abc"])
def test_notations_of_a_doi(spark, raw):
    assert spark.range(1).select(papers.clean_doi(F.lit(raw))).first()[0] == "10.1234/abc"


def test_the_publishers_doi_survives(spark):
    rows = [rec(1, "10.48550/arXiv.1", "On Foobar: a study"), rec(2, "10.1101/2020.1", "on foobar", alts=["10.48550/arXiv.1"]), rec(3, "10.5555/Pub", "On Foobar - a study", alts=["10.1101/2020.1"])]
    assert found(spark, rows) == dict.fromkeys((1, 2, 3), "10.5555/pub")


def test_parts_and_volumes_stay_apart(spark):
    rows = [rec(1, "10.1/a", "Foobar, Part I"), rec(2, "10.1/b", "Foobar, Part II"), rec(3, "10.1/c", "Alpha", alts=["10.9/vol"]), rec(4, "10.1/d", "Beta", alts=["10.9/vol"])]
    assert found(spark, rows) == {}


def test_a_shared_title_needs_a_doi_or_authors_and_year(spark):
    rows = [rec(1, "10.1000/a", "Editorial", ["A, A"]), rec(2, "10.1000/b", "Editorial", ["B, B"]), rec(3, "10.1000/b", "Editorial", ["B, B"]), rec(4, None, "Editorial", ["B, B"]), rec(5, None, "Editorial", ["C, C"])]
    assert found(spark, rows) == dict.fromkeys((2, 3, 4), "10.1000/b")


def test_a_volumes_doi_does_not_join_prefaces(spark):
    rows = [rec(1, "10.1000/a", "Preface", ["A, A"], 2020, alts=["10.1000/vol"]), rec(2, "10.1000/b", "Preface", ["B, B"], 2020, alts=["10.1000/vol"]), rec(3, "10.1000/c", "Rivers", ["C, C"], 2020, alts=["10.1000/vol"]), rec(4, "10.1000/c", "Rivers", ["C, C"], 2020, alts=["10.1000/vol"])]
    assert found(spark, rows) == dict.fromkeys((3, 4), "10.1000/c")


def test_consensus():
    assert papers.consensus([("Journal of Rivers", 16), ("J. Riv.", 4), ("JOURNAL OF RIVERS", 16)]) == "Journal of Rivers"
    assert papers.consensus([("a b c d", 1), ("a b d", 1), ("a x c d", 1)]) == "a b c d"


def test_every_one_of_very_many_values_votes(spark):
    rows = [rec(i, "10.1000/a", f"Foobar: subtitle {i % 300}", venue="Full Journal Name" if i % 3 else "Full J. N.") for i in range(1, 32)]
    merged = papers.merged_papers(spark.createDataFrame(rows, SCHEMAS["citation_records"])).collect()
    assert len(merged) == 1 and merged[0].venue == "Full Journal Name" and merged[0].records == 31


def test_light_values_vote_through_the_nearest_heavy_one(spark):
    # 70 venues of weight 1 and 2; the light ones are all near the second
    heavy = [(1, "venue", f"alpha{i} beta gamma", 2.0) for i in range(papers.MANY - 1)] + [(1, "venue", "Review of Rivers", 2.0)]
    light = [(1, "venue", f"Review of Rivers x{i}", 1.0) for i in range(300)]
    df = spark.createDataFrame(heavy + light, "component long, field string, value string, weight double")
    assert [(r.value, r.weight) for r in papers._elect(df).collect()] == [("Review of Rivers", 2.0 * papers.MANY + 300.0)]


def test_the_consensus_elects_the_doi(spark):
    rows = [rec(i, "10.48550/arXiv.7", "Foobar") for i in range(1, 9)] + [rec(9, "10.1101/77", "Foobar", alts=["10.48550/arXiv.7"]), rec(10, "10.5555/x-1", "Foobar", alts=["10.1101/77"])]
    df = spark.createDataFrame(rows, SCHEMAS["citation_records"])
    plan = papers.found(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and {r.doi for r in papers.found(df).collect()} == {"10.5555/x-1"}


def test_names_keep_their_semicolons(spark):
    m = papers.merged_papers(spark.createDataFrame([rec(1, "10.1000/a", "Foobar", ["Sato; Ana", "B, B"])], SCHEMAS["citation_records"])).first()
    assert m.authors == ["Sato; Ana", "B, B"]


def test_missing_values_are_filled_from_any_record(spark):
    rows = [rec(1, "10.1000/a", "Foobar", None, None), rec(2, "10.1000/a", None, ["Sato, Ana"], 2021, "Letters")]
    m = papers.merged_papers(spark.createDataFrame(rows, SCHEMAS["citation_records"])).first()
    assert (m.title, m.authors, m.year, m.venue, m.alt_dois) == ("Foobar", ["Sato, Ana"], 2021, "Letters", [])


def test_orcids_are_united(spark):
    a, b = list(rec(1, "10.1000/a", "Foobar")), list(rec(2, "10.1000/a", "Foobar"))
    a[9], b[9] = {"Sato, Ana": "1"}, {"Ana Sato": "1"}
    m = papers.merged_papers(spark.createDataFrame([tuple(a), tuple(b)], SCHEMAS["citation_records"])).first()
    assert m.orcids == {"Sato, Ana": "1", "Ana Sato": "1"}
