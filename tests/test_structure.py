from hypothesis import given, settings
from hypothesis import strategies as s

from sheaf.operators import structure as st


def names(text):
    return [x[0] for x in st.sections_in(text)]


def test_headings_in_code_and_of_one_character_are_none():
    assert names("# Top\n```\n# no\n```\n~~~\n## no\n~~~\n## Yes\n# x\n") == ["Top", "Yes"]


def test_an_open_fence_hides_nothing():
    assert st.fenced_ranges("```\ncode") == []
    assert names("```\n# Shown") == ["Shown"]


def test_a_fence_closes_with_the_same_mark_at_least_as_long():
    assert st.fenced_ranges("````\n```\n~~~\n````\n") == [(0, 17)]


def test_sections_span_to_the_next_heading():
    text = "# Aa\n\n## Bb\nbody\n"
    assert st.sections_in(text) == [("Aa", 1, 0, 6, True), ("Bb", 2, 6, len(text), False)]


@settings(max_examples=150, deadline=None)
@given(s.text(alphabet="ab .\n#é。", max_size=9000))
def test_semantic_chunks_join_to_the_text(text):
    chunks = st.semantic_chunks(text)
    assert "".join(c[2] for c in chunks) == text
    assert all(len(c[2]) <= 2000 for c in chunks)
    assert all(text[o : o + len(t)] == t for _, o, t in chunks)


def test_a_line_beyond_all_bounds_gives_no_chunks():
    assert st.semantic_chunks("x" * 1_000_001) is None
    assert st.line_chunks("x" * 1_000_001) is None


@settings(max_examples=100, deadline=None)
@given(s.lists(s.integers(0, 900), max_size=30))
def test_line_chunks_hold_whole_lines(sizes):
    text = "".join("x" * n + "\n" for n in sizes)
    chunks = st.line_chunks(text)
    assert "".join(c[2] for c in chunks) == text
    assert all(c[2].endswith("\n") and len(c[2]) <= 1800 for c in chunks)


def test_packing_allows_one_piece_over_while_little_is_used():
    assert st.packed_prefix(["a" * 9, "b" * 100], 100) == 2
    assert st.packed_prefix(["a" * 60, "b" * 60], 100) == 1
    assert st.packed_prefix(["a" * 500], 100) == 1


def test_packing_by_windows_keeps_what_packing_by_sums_keeps(spark):
    import random

    from pyspark.sql import functions as F

    random.seed(3)
    texts = {k: ["x" * random.randint(1, 60) for _ in range(random.randint(1, 9))] for k in range(60)}
    df = spark.createDataFrame([(k, i, t) for k, ts in texts.items() for i, t in enumerate(ts)], "k long, i int, t string")
    got = {r.k: (r.n, r.cut) for r in st.packed(df, "k", "i", F.length("t"), 100).groupBy("k").agg(F.count("*").alias("n"), F.max("cut").alias("cut")).collect()}
    want = {k: st.packed_prefix(ts, 100) for k, ts in texts.items()}
    assert got == {k: (n, n < len(texts[k])) for k, n in want.items()}


def test_whole_entries_within_a_budget(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 1, 60), (1, 2, 39), (1, 3, 1), (2, 1, 500), (2, 2, 1), (3, 1, 50), (3, 2, 60), (3, 3, 2)], "k long, i int, n int")
    assert sorted((r.k, r.i) for r in st.entries_within(df, "k", "i", F.col("n"), 100).where("kept").collect()) == [(1, 1), (1, 2), (2, 1), (3, 1)]


def test_fences_of_two_kinds_and_headings_between():
    text = "~~~\n```\n~~~~\n# In between\n````md\n# no\n```\n````\n# After\n```\n# Shown\n"
    assert names(text) == ["In between", "After", "Shown"]


def test_marked_posts(spark):
    rows = lambda md, kind: [r.text for r in st.marked_posts(spark.createDataFrame([(1, md), (2, None)], "id long, t string"), "id", "t", kind).orderBy("idx").collect()]
    assert rows("intro\n### 1\nfirst\n### 2\nsecond\n### two words\n", "posts") == ["intro", "### 1\nfirst", "### 2\nsecond\n### two words"]
    assert rows("### abc12\na\n##### q9\nb\n## no\n", "comments") == ["### abc12\na", "##### q9\nb\n## no"]
    assert rows("body\n## Comments\n### ic_7\nx\n### src/a.py\n#### rc_8\ny", "issues") == ["body\n## Comments", "### ic_7\nx", "### src/a.py", "#### rc_8\ny"]
    assert rows("no marks", "posts") == ["no marks"]
