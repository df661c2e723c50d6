import random

import pytest

from sheaf.llm.runs import cue_runs, same_words, slipped, spoken, window_runs

CUES = "video_id string, seg_idx int, start double, duration double, text string"


@pytest.mark.parametrize("a, b, ok", [("word", "wrd", True), ("word", "woord", True), ("word", "wrod", True), ("word", "ward", False), ("left", "right", False), ("12", "1", False), ("abcd", "badc", False), ("a", "ab", True)])
def test_slips(a, b, ok):
    assert slipped(a, b) is ok and slipped(b, a) is ok


def test_same_words():
    assert same_words("the quick fox", "teh quick foxx") and not same_words("step 4 of 9", "step 5 of 9") and not same_words(None, None)


def test_every_word_may_slip():
    words = "alpha bravo carbon delta echoes forest garden harbour island jungle kernel lantern".split()
    assert same_words(" ".join(words), " ".join(w[1:] for w in words))


def test_entities_in_capitals_are_no_words(spark):
    df = spark.createDataFrame([("v", 0, 0.0, 1.0, "&gt;&gt; Ann: so"), ("v", 1, 1.0, 1.0, "&GT;&GT; ANN: SO")], CUES)
    assert [r.cues for r in cue_runs(df, ["video_id"], "seg_idx").collect()] == [2]


def brute(rows, norm):
    by = {}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            by.setdefault(r[0], {})[r[1]] = r
    out = set()
    for v, cues in by.items():
        run = []
        for i in sorted(cues):
            n = norm[cues[i][4]]
            if run and same_words(run[-1][1], n):
                run.append((i, n))
            else:
                if run and run[0][1]:
                    out.add((v, run[0][0], run[-1][0], len(run)))
                run = [(i, n)]
        if run and run[0][1]:
            out.add((v, run[0][0], run[-1][0], len(run)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force_over_chunk_borders(spark, seed):
    random.seed(seed)
    texts = ["a b", "A  b!", "<i>a b</i>", "a c", "ab b", "&gt;&gt; a b", None, "", "x 1", "x 2"]
    rows = [(random.choice("vw"), i * random.choice([1, 1, 3]), float(i), random.choice([None, 0.0, 2.0]), random.choice(texts)) for i in range(60)]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    rows += random.sample(rows, 10)
    df = spark.createDataFrame(rows, CUES)
    norm = {r.text: r.w for r in df.select("text", spoken(df.text).alias("w")).collect()}
    got = {(r.video_id, r.first_idx, r.last_idx, r.cues) for r in cue_runs(df, ["video_id"], "seg_idx", chunk=7).collect()}
    assert got == brute(rows, norm)


def test_duration_is_the_whole_run(spark):
    df = spark.createDataFrame([("v", 0, 1.0, 2.0, "a"), ("v", 1, 3.0, None, "a"), ("v", 2, 4.0, 5.0, "A")], CUES)
    r = cue_runs(df, ["video_id"], "seg_idx").first()
    assert (r.cues, r.start, r.duration) == (3, 1.0, 8.0)


def test_runs_go_on_over_windows(spark):
    df = spark.createDataFrame([("v", 0, [(0.0, 1.0, "x"), (1.0, 1.0, "y")]), ("v", 1, [(2.0, 1.0, "Y"), (3.0, 1.0, "z")])], "video_id string, win_idx int, segments array<struct<start:double,duration:double,text:string>>")
    assert sorted(r.cues for r in window_runs(df).collect()) == [1, 1, 2]
    r = window_runs(df, least=2).first()
    assert (r.first_win, r.first_pos, r.last_win, r.last_pos, r.duration) == (0, 1, 1, 0, 2.0)


def test_long_windows_do_not_collide(spark):
    a, b = [(0.0, 1.0, f"word{i % 2}") for i in range(100_001)], [(0.0, 1.0, "word0")]
    df = spark.createDataFrame([("v", 0, a), ("v", 1, b)], "video_id string, win_idx int, segments array<struct<start:double,duration:double,text:string>>")
    assert [(r.first_win, r.first_pos, r.last_win) for r in window_runs(df, least=2).collect()] == [(0, 100_000, 1)]
