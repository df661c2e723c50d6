from hypothesis import given, settings
from hypothesis import strategies as s

from sheaf.llm.sections import MAX_CHARS, OVERLAP, cut_points, split_sections


def check(text):
    pieces = cut_points(text)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert a < c <= b < d and b - c <= OVERLAP
    assert all(0 < b - a <= MAX_CHARS for a, b in pieces)
    return pieces


@settings(max_examples=120, deadline=None)
@given(s.lists(s.text(alphabet="abc d.e\nfé。", min_size=1, max_size=60), min_size=1, max_size=200))
def test_pieces_cover_the_text_within_the_limit(parts):
    text = " ".join(parts)
    if len(text) > MAX_CHARS:
        check(text)
    else:
        assert cut_points(text) == [(0, len(text))]


def test_text_without_boundaries_is_cut_hard():
    assert len(check("x" * 9001)) >= 5


def test_an_edit_moves_only_the_pieces_beside_it():
    import random

    random.seed(3)
    words = [random.choice("river stone harbour light paper engine quiet seven bridge".split()) for _ in range(9000)]
    text = "".join(w + (". " if i % 11 == 10 else "\n\n" if i % 97 == 96 else " ") for i, w in enumerate(words))
    one = {text[a:b] for a, b in check(text)}
    edited = text[:500] + "some words that were not there before " + text[500:]
    two = {edited[a:b] for a, b in check(edited)}
    assert len(two - one) <= len(two) // 4


def test_pieces_stay_in_their_section(spark):
    text = "# One\n" + "word " * 900 + "\n# Two\nshort"
    cut = text.index("# Two")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    secs = spark.createDataFrame([(1, 1, 1, 0, cut, None), (1, 2, 1, cut, None, None)], "doc_id long, section_no int, level int, start_pos int, end_pos int, extracted_at timestamp")
    rows = split_sections(docs, secs).orderBy("piece_no").collect()
    assert {r.section_no for r in rows} == {1} and rows[-1].end_pos == cut
    assert all(text[r.start_pos : r.end_pos] == r.text for r in rows)


def test_an_edit_moves_only_the_pieces_next_to_it():
    import random

    random.seed(9)
    words = "river stone harbour light paper engine quiet seven".split()
    text = " ".join(" ".join(random.choice(words) for _ in range(random.randint(4, 14))).capitalize() + random.choice([".", ".\n", ".\n\n"]) for _ in range(900))
    at = len(text) // 2
    edited = text[:at] + " a new sentence stands here." + text[at:]
    kept = lambda t: {t[a:b] for a, b in cut_points(t)}
    a, b = kept(text), kept(edited)
    assert len(a) > 20 and len(a - b) <= 6
