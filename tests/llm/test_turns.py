from sheaf.llm import turns
from tests.llm.test_edges import SCHEMAS


def starts(spark, texts, chapters=()):
    rows = [("v", i, float(i), 1.0, t, "en", False, None) for i, t in enumerate(texts)]
    caps = spark.createDataFrame(rows, SCHEMAS["captions"])
    ch = spark.createDataFrame([("v", 0.0, 9.0, t) for t in chapters], SCHEMAS["chapters"])
    return sorted(r.first_idx for r in turns.found(caps, ch).collect())


def test_ways_to_write_a_label(spark):
    assert starts(spark, ["Lucan Posa: hi", "LUCAN: more", "L. Posa: more", "Gwen: hello", "Dr. Posa: back", "POSA - still", "(Gwen) now", "[Lucan Posa] then", "&gt;&gt; Gwen Fiva: end", "Lcuan: slip"]) == [0, 3, 4, 6, 7, 8, 9]


def test_openers_sounds_and_times_are_no_labels(spark):
    assert starts(spark, ["Gwen: a", "Note: careful", "[Music]", "(laughter) yes", "At 10:30 we go", "One more thing: x", "Part two: y", "[00:01:00] Gwen: z"]) == [0]


def test_in_mid_cue(spark):
    assert starts(spark, ["Gwen: a", "so it ends. FARID ODA: and mine begins"]) == [0, 1]


def test_signs_alone(spark):
    assert starts(spark, ["hello", ">> yes", ">> yes", "and", "&gt;&gt; no"]) == [1, 4]
    assert starts(spark, ["- oui", "et", "— non"]) == [0, 2]


def test_roles(spark):
    assert starts(spark, ["Speaker 1: a", "SPEAKER 1: b", "Speaker2: c", "[speaker 2] d", "Host - e"]) == [0, 2, 4]


def test_chapters_name_a_speaker(spark):
    assert starts(spark, ["Oda: a", "Farid: b", "F. Oda: c"], ["Q&A with Farid Oda"]) == [0]


def test_turns_are_clean(spark):
    rows = [("v", 0, 0.0, 1.0, "[00:00:01] Gwen: um, I see ♪ the", "en", False, None), ("v", 1, 1.0, 1.0, "I see the river. FARID: [Music] uh, yes", "en", False, None)]
    out = turns.speaker_turns(spark.createDataFrame(rows, SCHEMAS["captions"]), spark.createDataFrame([], SCHEMAS["chapters"])).orderBy("turn_no").collect()
    assert [(r.speaker, r.text) for r in out] == [("gwen", "I see the river."), ("farid", "yes")]


def turn_texts(spark, cues):
    rows = [("v", i, s, d, t, "en", False, None) for i, (s, d, t) in enumerate(cues)]
    out = turns.speaker_turns(spark.createDataFrame(rows, SCHEMAS["captions"]), spark.createDataFrame([], SCHEMAS["chapters"]))
    turns_of = {}
    for r in out.orderBy("turn_no", "part").collect():
        t = turns_of.setdefault(r.turn_no, [r.speaker, r.first_idx, r.start, r.end_time, []])
        assert t[0] == r.speaker and len(t[4]) == r.part
        t[3] = max(t[3] or 0.0, r.end_time or 0.0)
        t[4].append(r.text)
    return [(n, *t[:4], " ".join(t[4])) for n, t in turns_of.items()]


def test_pauses_split_what_nobody_is_named_for(spark):
    # over chunks: the second pause stands at a chunk's border
    at, cues = 0.0, []
    for i in range(turns.CHUNK + 10):
        at += 9.0 if i in (5, turns.CHUNK) else 0.25 * (i % 3)
        cues.append((at, 2.0, f"w{i}"))
        at += 2.0
    got = turn_texts(spark, cues)
    assert [(n, who, first) for n, who, first, *_ in got] == [(0, None, 0), (1, None, 5), (2, None, turns.CHUNK)]
    assert got[0][5] == "w0 w1 w2 w3 w4" and got[1][3] == cues[5][0] and got[1][4] == cues[turns.CHUNK - 1][0] + 2.0


def test_pauses_are_measured_by_the_video(spark):
    slow = [(i * 5.0, 2.0, f"w{i}") for i in range(9)]
    assert len(turn_texts(spark, slow)) == 1
    # a sound and repeated cues are no pause's end and no pause; a named speaker may pause
    cues = [(0.0, 1.0, "one"), (1.0, 1.0, "two"), (2.0, 1.0, "two"), (3.0, 4.0, "Two."), (7.0, 1.0, "three"), (13.0, 1.0, "[Music]"), (14.0, 1.0, "four"), (15.0, 1.0, "Gwen: five"), (29.0, 1.0, "six"), *((30.0 + i, 1.0, f"x{i}") for i in range(9)), (None, None, "seven")]
    assert [x[1:3] + x[5:] for x in turn_texts(spark, cues)] == [(None, 0, "one two three"), (None, 6, "four"), ("gwen", 7, "five six x0 x1 x2 x3 x4 x5 x6 x7 x8 seven")]


def test_repetition_is_taken_away():
    words = [f"w{i}" for i in range(100)]
    long = " ".join(words[10:])
    assert long[turns.new_from(" ".join(words[:80]), long) :].split() == words[80:]
    assert turns.new_from("a b", "b c") == 0 and "b c d"[turns.new_from("a b c", "b c d") :] == " d"
    assert turns.new_from("Ann: so we go", "ANN: So w go.") == len("ANN: So w go.") and turns.new_from(None, "x y") == 0


def test_a_label_in_what_is_repeated_begins_no_turn(spark):
    assert starts(spark, ["Gwen: a river", "Farid: of stone", "Farid: of stone and Gwen: more"]) == [0, 1, 2]
    assert starts(spark, ["so. Gwen: it ends. Farid: and", "Gwen: it ends. Farid: and now"]) == [0]


def test_repetition_over_chunks(spark):
    rows = [("v", i, float(i), 1.0, "w" + str(i), "en", False, None) for i in range(turns.CHUNK - 1)] + [("v", turns.CHUNK - 1, 900.0, 1.0, "Ann Poe: and so", "en", False, None), ("v", turns.CHUNK, 901.0, 1.0, "Bob Orr: here", "en", False, None), ("v", turns.CHUNK + 1, 902.0, 1.0, "Bob Orr: here", "en", False, None), ("v", 2 * turns.CHUNK - 1, 950.0, 1.0, "Ann Poe: yes. Bob Orr: no", "en", False, None), ("v", 2 * turns.CHUNK, 951.0, 1.0, "Ann Poe: yes. Bob Orr: no", "en", False, None)]
    caps, ch = spark.createDataFrame(rows, SCHEMAS["captions"]), spark.createDataFrame([], SCHEMAS["chapters"])
    assert sorted(r.first_idx for r in turns.found(caps, ch).collect()) == [turns.CHUNK - 1, turns.CHUNK, 2 * turns.CHUNK - 1]


def test_openers_are_told_from_all_videos(spark):
    rows = [(f"v{v}", i, float(i), 1.0, t, "en", False, None) for v in range(9) for i, t in enumerate(["Gwen: Sidebar: a", "Farid: b", "Sidebar: c", "Gwen: d"])]
    caps, ch = spark.createDataFrame(rows, SCHEMAS["captions"]), spark.createDataFrame([], SCHEMAS["chapters"])
    assert sorted({r.first_idx for r in turns.found(caps, ch).collect()}) == [0, 1, 3]


def test_labels_of_three_words(spark):
    assert starts(spark, ["Ana Maria Sato: a", "Gwen: b", "Ana Maria Sato: c", "A. Sato: d"]) == [0, 1, 2]
