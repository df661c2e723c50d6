import pytest

from sheaf.operators.search import Query, bm25, matching

DOCS = [(1, "the quick brown fox"), (2, "quick red fox jumps"), (3, "lazy brown dog"), (4, None), (5, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, t string")


@pytest.mark.parametrize(
    "query, hits",
    [("quick dog", {1, 2, 3}), ("+quick +brown", {1}), ("fox -red", {1}), ('"quick brown"', {1}), ('"quick fox"', set()), ('"quick fox"~1', {1, 2}), ("brwn~1", {1, 3}), ("(red OR lazy) AND fox", {2}), ("quick NOT red", {1}), ("", set()), ("QUICK", {1, 2})],
)
def test_grammar(docs, query, hits):
    assert {r.id for r in matching(docs, "id", "t", query).collect()} == hits


@pytest.mark.parametrize("query, hit", [('"new new"~1', False), ('"new york"~1', True), ('"york new"~1', False), ('"new times"~1', True), ('"new times"~0', False), ('"new york times"~2', True), ('"york york"~3', False)])
def test_a_place_counts_once_in_a_phrase_with_slop(spark, query, hit):
    assert bool(matching(spark.createDataFrame([(1, "new york times")], "id long, t string"), "id", "t", query).collect()) is hit


def test_a_stray_mark_warns_and_does_not_fail():
    assert Query("foo:bar").warnings and Query("(open").warnings and Query(")").warnings


def test_ties_go_to_the_key(docs):
    assert [r.id for r in bm25(docs, "id", "t", ["fox"]).collect()] == [1, 2]


def test_no_rows_no_hits(spark):
    assert bm25(spark.createDataFrame([], "id long, t string"), "id", "t", ["x"]).collect() == []
