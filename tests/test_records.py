import itertools

from sheaf.operators import html, shelf, state

J, P = "10.1000/j", "10.48550/arXiv.1"


def record(doi, alt=(), **more):
    return {"doi": doi, "alt_dois": list(alt), "title": "t", "added": None, "score": None, "confirmed": False, "notes": None, "retraction": None} | more


def test_preprint_then_journal_in_either_order_is_one_record_under_the_journal():
    for order in itertools.permutations([record(P), record(J, [P])]):
        store = {}
        for r in order:
            shelf.upsert(store, r)
        assert list(store) == [J] and store[J]["alt_dois"] == [P]


def test_user_fields_stay_and_a_retraction_never_goes():
    store = {}
    shelf.upsert(store, record(J, score=5, notes="n", confirmed=True, added="2024"))
    note = shelf.upsert(store, record(J, retraction={"date": "2025"}))
    assert "moved" in note and store[J]["score"] == 5 and store[J]["added"] == "2024"
    assert shelf.upsert(store, record(J)) is None
    assert store[J]["retraction"] == {"date": "2025"}


def test_equal_priority_goes_to_the_least_doi():
    store = {}
    shelf.upsert(store, record("10.2/b"))
    shelf.upsert(store, record("10.2/a", ["10.2/b"]))
    assert list(store) == ["10.2/a"]


def test_a_scan_does_not_evict_what_was_asked_for_again():
    cache = state.TwoQueues(3)
    cache.store("a")
    assert cache.get("a")
    for k in "bcdefg":
        cache.store(k)
    assert "a" in cache and len(cache.probation) == 2


def test_another_renderer_is_a_miss_without_promotion():
    cache = state.TwoQueues(2)
    cache.store("a", renderer="x")
    assert not cache.get("a", renderer="y") and "a" in cache.probation


def test_groups_leave_together():
    cache = state.TwoQueues(2)
    cache.store("a", group="g")
    cache.store("b", group="g")
    assert sorted(cache.store("c")) == ["a", "b"]


PAGE = "<html><head><title>T &amp; U</title></head><body><nav>menu</nav><h1>Real <b>Title</b></h1><p>One <b>two</b> <a href='/x'>three</a>.</p><ul><li>a</li><li>b</li></ul><pre>x = 1\n# no</pre><table><tr><td>1</td><td>2</td></tr></table><img src=i alt=Pic><footer>f</footer></body></html>"


def test_html_to_markdown():
    title, text = html.html_to_markdown(PAGE)
    assert title == "Real Title"
    assert "# Real Title" in text and "menu" not in text and "footer" not in text
    assert "One **two** [three](/x)." in text and "*   a\n*   b" in text and "```\nx = 1\n# no\n```" in text and "| 1 | 2 |" in text and "[Image: Pic]" in text
    assert "\n\n\n" not in text


def test_titles_fall_back():
    assert html.html_to_markdown("<title> a\n b </title><p>x</p>")[0] == "a b"
    assert html.html_to_markdown("<meta property='og:title' content='O'><title>t</title>")[0] == "O"
    assert html.html_to_markdown(None) == ("Untitled", "") and html.html_to_markdown("<p>x")[0] == "Untitled"


def test_list_headings_come_out():
    assert html.promote_list_headings("*   ## H\n    body\nnext") == "## H\nbody\nnext"
    assert html.promote_list_headings("```\n* # no\n```") == "```\n* # no\n```"
    assert html.promote_list_headings("- # A\n  one\n\n    deep\n - ## B\nout\n1. ### C") == "# A\none\n\n  deep\n## B\nout\n### C"


def test_all_blocks_of_a_heading_are_flattened(spark):
    from pyspark.sql import functions as F

    page = "<h2 class=a><div>One</div><p>Two<br/>three</p></h2><div>x</div><h4>Plain</h4><h5><section>y</section></h5>"
    assert spark.range(1).select(html.flatten_heading_blocks(F.lit(page))).first()[0] == "<h2 class=a>One Two three</h2><div>x</div><h4>Plain</h4><h5>y</h5>"


def test_long_ids_keep_their_own_paths(spark):
    from sheaf.operators.threads import thread_tree

    ids = [1000000000001, 1000000000002, 9]
    rows = thread_tree(spark.createDataFrame([(1, i, None) for i in ids], "t long, n long, p long"), "t", "n", "p").orderBy("path").collect()
    assert [r.n for r in rows] == sorted(ids)


def test_any_contents_box_goes_from_a_forum_post(spark):
    from pyspark.sql import functions as F

    from sheaf.functions.text import clean_forum_post

    assert spark.range(1).select(clean_forum_post(F.lit('a <div class="x" data-theme-toc="true" id=y> <b>toc</b> </div>b <div>c</div>'))).first()[0] == "a b <div>c</div>"


def test_shells_that_scripts_fill():
    assert html.needs_scripts("<noscript>Enable JavaScript</noscript>") and html.needs_scripts("<div id='root'></div>")
    assert not html.needs_scripts("<div id='root'>x</div>") and not html.needs_scripts(None)


def test_elements_once_each():
    got = html.interactive_elements('<a href="/a">A</a><a href="/a">B</a><button>Go</button><input name="q" placeholder="find">')
    assert got == [("a", "A", "/a"), ("button", "Go", ""), ("input", "find", "q")]
