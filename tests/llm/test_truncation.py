import random

from sheaf.llm.truncation import truncated, truncation_rates

WORDS = "river stone harbour light paper engine quiet seven bridge window market garden silver".split()


def corpus():
    random.seed(4)
    docs, cut = [], set()
    sentence = lambda: ("the " + " ".join(random.choice(WORDS) for _ in range(random.randint(6, 12)))).capitalize() + "."
    tails = ["\n\n- stone river", "\n\n## Harbour", "\n\n| a | b |", "\n\n```\nx = 1\n```", "\n\nhttps://a.test/b", ""]
    for i in range(600):
        text = " ".join(sentence() for _ in range(12))
        if i % 10 == 0:
            text, _ = text[: random.randint(200, len(text) - 5)].rstrip(".") , cut.add(i)
            if text[-1:] in " ":
                text = text.rstrip()
            if text.endswith("."):
                cut.discard(i)
        elif i % 10 == 1:
            text = text[:300]
            cut.add(i) if not text.rstrip().endswith(".") else None
        else:
            text += tails[i % len(tails)]
        docs.append((i, "forum" if i % 10 == 1 else "web", text))
    return docs, cut


def test_cut_texts_are_found_and_whole_ones_are_not(spark):
    docs, cut = corpus()
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = {r.doc_id for r in truncated(df).collect()}
    assert len(got & cut) / len(cut) > 0.95 and len(got & cut) / len(got) > 0.95
    rates = {r.source: r.share for r in truncation_rates(df).collect()}
    assert rates["forum"] > 0.9 > rates["web"]


def test_marks_of_a_cut_are_taken_away_before_the_trigram_is_judged(spark):
    whole = [(i, "w", "All of the river is whole and all of the stone is too. “So it was.”") for i in range(10, 80)]
    df = spark.createDataFrame([(1, "w", "A whole sentence. And a part of…"), (2, "w", "A whole sentence, with stones. And half of it \ufffd"), (3, "w", "All is whole."), (4, "w", "“All is whole.”"), (5, "w", " \n"), (6, "w", "The stone is on the shelf.\n\nsee the shelf."), *whole], "doc_id long, source string, text string")
    assert {r.doc_id: r.evidence for r in truncated(df).collect()} == {1: "trigram", 2: "trigram"}


def test_scripts_without_spaces(spark):
    docs = [(i, "w", "この資料には52個の資料があり、変換表によって整理される。文書と区間を比べると、目次のほうが早く更新される。") for i in range(70)]
    df = spark.createDataFrame([*docs, (100, "w", "この資料には52個の資料があり、変換表によって整理される。文書と区間を比")], "doc_id long, source string, text string")
    assert [r.doc_id for r in truncated(df).collect()] == [100]


def test_a_limit_is_evidence_only_and_decides_in_speech_alone(spark):
    random.seed(8)
    prose = [(i, "s", ("The " + " ".join(random.choice(WORDS) for _ in range(30))).capitalize() + ".") for i in range(100)]
    prose = [(i, s, t[:-1][:150] + ".") for i, s, t in prose]  # whole texts of one length
    speech = [(1000 + i, "captions", " ".join(random.choice(WORDS) for _ in range(400))[:900]) for i in range(20)] + [(2000 + i, "captions", " ".join(random.choice(WORDS) for _ in range(100 + 7 * i))) for i in range(60)]
    got = {r.doc_id: (r.evidence, r.at_limit) for r in truncated(spark.createDataFrame(prose + speech, "doc_id long, source string, text string")).collect()}
    assert set(got) == {1000 + i for i in range(20)} and all(at for _, at in got.values())


def test_cuts_inside_lists_tables_headings_and_fences(spark):
    random.seed(6)
    sentence = lambda: ("the " + " ".join(random.choice(WORDS) for _ in range(8))).capitalize() + "."
    pair = lambda: f"{random.choice(WORDS[:6])} of the {random.choice(WORDS)}"
    whole = {"list": lambda: "- " + pair(), "heading": lambda: "## The " + pair(), "table": lambda: f"| {pair()} | {pair()} |", "fence": lambda: "```\nx = 1\n```"}
    docs = []
    for i in range(400):
        kind = whole[list(whole)[i % 4]]
        docs.append((i, f"site {i}", "\n\n".join([sentence(), *(kind() for _ in range(4))])))  # no source has a field limit
    ends = {
        1000: "- river of the", 1001: "- river of the harb", 1002: "## The river of", 1003: "## The river of the lig", 1004: "| stone of the paper | river of the", 1005: "| stone of the paper | river of the eng",
        1006: "```\nx = 1", 1007: "~~~py\ndef f(x):", 1008: "```\n~~~\n", 1009: "| stone of the paper | river",
        2000: "```\n~~~\n```", 2001: "- river of the harbour", 2002: "~~~~\n~~~\nx\n~~~~", 2003: "Say ``` twice.", 2004: "## The river of the light",
    }
    docs += [(i, "web", sentence() + "\n\n" + end) for i, end in ends.items()]
    got = {r.doc_id for r in truncated(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()}
    assert got == {i for i in ends if i < 2000}


def test_speech_is_told_by_the_whole_text(spark):
    from sheaf.llm import truncation

    words = " ".join(WORDS * 20)
    texts = {"starts unmarked": words[:700] + " The river. " + "A stone, a bridge. " * 40, "one mark": "so, " + words[:1500], "no mark": words[:300], "prose": "The river. " * 30}
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    assert {r.name for r in df.where(truncation._SPOKEN).collect()} == {"one mark", "no mark"}
