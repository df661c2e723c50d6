import random

from sheaf.llm import pages
from tests.llm.test_edges import SCHEMAS

WORDS = "river stone harbour light paper engine quiet seven bridge window market garden silver".split()


def sentence(n=12):
    return " ".join(random.choice(WORDS) for _ in range(n)).capitalize() + "."


def site(i, named):
    """A page and the numbers of its main lines."""
    tag = {"main": "main", "nav": "nav", "foot": "footer"} if named else {"main": "div", "nav": "div", "foot": "div"}
    lines, main = ["<html><body>", f"<{tag['nav']}>"], []
    lines += [f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "About", "Contact", "Log in")] + [f"</{tag['nav']}>", f"<{tag['main']}>"]
    for k, x in enumerate([f"<h1>{sentence(3)[:-1]}</h1>", f"<p>{sentence()}</p>", f"<p>{sentence()} {sentence()}</p>", "<p>Advertisement</p>", f"<li>{random.choice(WORDS)} {random.choice(WORDS)}</li>", f"<p>{sentence()}</p>"]):
        lines.append(x)
        if k != 3:
            main.append(len(lines))
    lines += [f"</{tag['main']}>", f"<{tag['foot']}>", "<p>© 2024 Site. All rights reserved.</p>", "<p>Back to top</p>", f"</{tag['foot']}>", "</body></html>"]
    return "\n".join(lines), main


def test_held_out_pages_without_names(spark):
    random.seed(11)
    rows, truth = [], {}
    for i in range(80):
        named = i < 50
        text, main = site(i, named)
        rows.append((i, f"http://s{i % 20}.test/{i}", 200, {"content-type": "text/html"}, bytearray(text.encode()), None, None, None, None, None))
        if not named:
            truth[i] = set(main)
    got = {}
    for r in pages.found(spark.createDataFrame(rows, SCHEMAS["fetch_responses"])).collect():
        got.setdefault(r.fetch_id, set()).add(r.line_no)
    right = sum(len(truth[i] & got.get(i, set())) for i in truth)
    assert right / sum(map(len, truth.values())) > 0.95 and right / sum(len(got.get(i, ())) for i in truth) > 0.95


def test_messages_are_exact_marginals():
    """Sum-product against enumeration of all labellings of a small tree."""
    import itertools
    import math

    import numpy as np

    page = pages.Page("<html><body><div><p>one</p>\n<p>two</p></div>\n<div>three</div></body></html>")
    evidence = np.array([1.0, -0.5, 2.0])
    agree = {"chain": 0.8, "top": 0.6, "item": 0.9, "inner": 0.85, "line": 0.95}
    n = len(page.tag)
    total = np.zeros(2 * 0 + len(page.lines))
    z = 0.0
    for labels in itertools.product((0, 1), repeat=n + len(page.lines)):
        p = 1.0
        for i in range(1, n):
            a = agree[pages.edge_kind(page, i)]
            p *= a if labels[i] == labels[page.parent[i]] else 1 - a
        for k, line in enumerate(page.lines):
            p *= (agree["line"] if labels[n + k] == labels[line["node"]] else 1 - agree["line"]) * math.exp(evidence[k] * labels[n + k])
        z += p
        total += p * np.array(labels[n:])
    assert np.allclose(pages.marginals(page, evidence, agree), total / z)


def test_charsets():
    assert pages.decode("é".encode("utf-16"), "text/html; charset=UTF-16") == "é"
    assert pages.decode("é".encode("latin-1"), 'text/html; charset="ISO-8859-1"') == "é"
    assert pages.decode("é".encode(), None) == "é" and pages.decode(b"\xff\xfa", "x; charset=nope") and pages.decode(None, None) == ""


def test_lines_count_at_the_line_feed():
    page = pages.Page("<html>\n<script>var a = '<p>no</p>';\n</script>\n<p>one\ntwo</p></html>")
    assert [(a["no"], a["text"]) for a in page.lines] == [(4, "one"), (5, "two")]


def test_what_a_site_lists_goes_as_a_block(spark):
    """Lists of titles no other page has, below a heading of the site, in text without marks."""
    random.seed(12)
    rows, truth = [], {}
    title = lambda: " ".join(random.choice(WORDS) for _ in range(random.randint(1, 7))).capitalize()
    for i in range(120):
        listed, letter = [title() for _ in range(5)], f"Sign up for our weekly {random.choice(WORDS)} letter"
        if i < 70:
            body = [f"<h1>{sentence(3)[:-1]}</h1>", f"<p>{sentence()}</p>", f"<div>{letter}</div>", f"<p>{sentence()} {sentence()}</p>"]
            lines = ["<html><body><main>", *body, "</main><aside>", "<h3>Most read</h3>", *(f'<li><a href="/{k}">{x}</a></li>' for k, x in enumerate(listed)), "</aside><footer>", "<p>Back to top</p>", "</footer></body></html>"]
            kind = "text/html"
        else:
            lines = [title(), "", sentence(), "", letter, "", sentence() + " " + sentence(), "", "Most read", *listed, "", "Back to top"]
            truth[i], kind = {1, 3, 7}, "text/plain"
        rows.append((i, f"http://s{i % 10}.test/{i}", 200, {"content-type": kind}, bytearray("\n".join(lines).encode()), None, None, None, None, None))
    got = {}
    for r in pages.found(spark.createDataFrame(rows, SCHEMAS["fetch_responses"])).collect():
        got.setdefault(r.fetch_id, set()).add(r.line_no)
    wrong = sum(len(truth[i] ^ got.get(i, set())) for i in truth)
    assert wrong <= 0.05 * sum(map(len, truth.values()))


def test_code_with_tags_is_no_markup():
    assert not pages.Page("Some text\n\n```\n<div>x</div>\n```\n", "text/markdown").html and not pages.Page("Some text <p>").html
    assert pages.Page("  <p>x</p>").html and pages.Page("x\n" * 9000 + "<p>x</p>", "text/html").html


def test_a_page_is_what_was_kept_of_it():
    page = pages.Page("<html><body><main><p>one</p>\n<p>two <a href=x>three</a></p></main></body></html>", "text/html")
    assert pages.Page.load(page.dump()).__dict__ == page.__dict__
