"""Payload readers on bodies that are null, broken or empty, and small parsers."""

import pytest

from sheaf.operators import reports
from sheaf.sources import services

READERS = [services.csl, services.registry_record, services.registered_work, services.references, services.standard, services.standards_found, services.repository, services.file_tree, services.package_version, services.dependencies, services.project, services.advisory, services.community_listing, services.forum_search, services.video_comments, services.web_results, services.wiki_page]


@pytest.mark.parametrize("read", READERS, ids=lambda f: f.__name__)
def test_a_body_that_cannot_be_read_gives_no_row_and_never_fails(spark, read):
    df = spark.createDataFrame([("a", None), ("b", "broken {"), ("c", "")], "k string, body string")
    assert read(df, "k", "body").collect() == []
    spark.createDataFrame([("d", "{}"), ("e", "[]"), ("f", "1")], "k string, body string").transform(lambda d: read(d, "k", "body")).collect()


def test_indented_maps_and_lists():
    assert reports._yaml("a: 1\nb:\n  - c: x\n    d: 'y'\n  - plain\ne:\n  f: g\n# no\n") == {"a": "1", "b": [{"c": "x", "d": "y"}, "plain"], "e": {"f": "g"}}
    assert reports._yaml("") == {} and reports._yaml("- a\n- b") == {}


def test_an_issue_without_comments_has_a_head_and_no_hint(spark):
    issues = spark.createDataFrame([(1, "o/r", "open", "ann", None, None)], "issue long, repo string, state string, author string, association string, body string")
    comments = spark.createDataFrame([], "issue long, id long, author string, association string, body string")
    assert [r.line for r in reports.issue_lines(issues, comments).orderBy("part").collect()] == ["**o/r#1** | open | 0 comments", "**@ann**"]
