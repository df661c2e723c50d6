"""Transcripts into speaker turns (problem 7).

A sweep line goes over the timed cues of a video in order of their start. What
the end of one cue and the start of the next have in common is rolling-caption
repetition and is taken away first; labels in any way of writing (Name:, NAME -,
[Name], (name), F. Last:, Dr. Last:, a slipped letter) and signs (>>, a dash) are
read from what is new in each cue. What looks like a label but often follows
another one in its cue ("Ana: Note: ..."), or begins chapter titles, is an
opener, which is told from all videos. A video's few distinct labels and its chapters' names form its roster; a
turn begins where the roster's speaker changes, or at each sign where there are
no labels. Where nothing has marked a speaker yet, a turn also begins after a
pause: a gap far out of all the video's gaps. The sweep goes over chunks of a
video, joined by a summary row each, so a live stream spreads.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.names import slips
from sheaf.llm.runs import same_words, slipped
from sheaf.session import cut

CHUNK = 512
PAUSE = 1.0  # least seconds of a pause; a video's own gaps may ask for more

OPENER = 0.15  # share of a label's occurrences after another label in one cue, or as it begins titles, from which it is an opener
TITLES = 0.005  # share of the videos with chapters in whose titles a word before a colon is usual
BELIEF, LISTED = 8, 0.3  # the share of listed openers counts as so many occurrences, until there are more

# fixed values: speakers by role, usual openers, sounds, fillers
ROLES = {"host", "cohost", "co-host", "guest", "moderator", "speaker", "interviewer", "interviewee", "narrator", "presenter", "announcer", "audience", "caller", "panelist", "reporter", "anchor", "voice", "questioner", "respondent", "participant", "man", "woman"}
OPENERS = set("remember reminder warning note notes so thing version part chapter section step tip hint update spoiler example question answer summary important attention caution ps nb recap conclusion first second third finally one two three four five six seven eight nine ten today next also and but well okay ok result results problem solution fact rule point bonus disclaimer quote translation subtitles source sources credits link links topic title see here this that is are was chapter".split())
SOUNDS = re.compile(r"^(?:music|applause|laugh|laughs|laughter|laughing|inaudible|crosstalk|silence|pause|cough|coughs|coughing|cheer|cheers|cheering|sigh|sighs|noise|static|door|phone|bell|clap|claps|clapping|whisper|whispers|chuckle|chuckles|crowd|singing|unintelligible|indistinct|background|foreign|sniff|sniffs|gasp|gasps|beep|bleep|click|typing|wind|rain|footsteps|thunder|engine|playing|closes|opens|rings|musik|applaus|lachen|musique|rires|applaudissements|música|risas|aplausos)\b|\b(?:music|playing|closes|opens|rings|noise|laughter|applause)$", re.I)

_TIME = re.compile(r"[\[(]?\b\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?\b[\])]?")
_LEAD_TIME = re.compile(r"^\s*(?:[\[(]\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?[\])]|\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?)\s*")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|\{\\[^}]*\}")
_WORD = r"[^\W\d_][\w'’.-]*"
_NAME = rf"(?:(?:Dr|Prof|Mr|Mrs|Ms|DR|PROF|dr|prof)\.?\s+)?{_WORD}(?:\s+{_WORD})?(?:\s?\#?\d{{1,2}})?"
_LABEL = re.compile(
    rf"(?:^|(?<=\s)|(?<=>))(?:(?P<sign>>>+|[-–—](?=\s*\S))\s*)?(?:[\[(]\s*(?P<bracket>{_NAME})\s*[\])]:?(?=\s|$)|(?P<colon>{_NAME})\s{{0,2}}:(?=\s|$)|(?P<dash>(?:[^\W\d_a-z][^\W\d_a-z'’-]+|[A-Z][a-z]+)(?:\s?\d{{1,2}})?)\s+[-–—]\s+(?=\S))"
)
_MORE_NAMES = re.compile(r"(?:(?<=^)|(?<=[.?!…]\s)|(?<=>\s))((?:[A-Z][\w'’-]*\.?\s+){1,2})$")
_SIGN = re.compile(r"^\s*(?:>>+|[-–—])\s*|(?<=[.?!…])\s+(?:>>+|[-–—])\s+|\s+>>+\s*")
_SOUND_MARK = re.compile(r"[♪♫]+|\*[a-z][a-z ]{2,20}\*|[\[(]\s*([^\])]{2,30}?)\s*[\])]", re.I)
_FILLER = re.compile(r"(?:(?<=^)|(?<=[\s,.?!]))(?:u+h+m*|u+m+|e+r+m*|a+h+|h+m+|you know|I mean|i mean|sort of|kind of|like)(?=,),\s*|(?:(?<=^)|(?<=\s))(?:u+h+m*|u+m+|e+r+m*|h+m+)(?=[\s,.?!]|$),?\s*")


def visible(text: str | None) -> str:
    """A cue without entities and markup."""
    if not text:
        return ""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text or "{" in text:
        text = _TAG.sub(" ", text)
    return text.replace("\n", " ")


def cue_marks(text: str) -> tuple[list[tuple[int, int, str, str, bool, int, bool]], int]:
    """Labels of a cue (start, end, longer form, shorter form, certain, start of the shorter, with a sign) and the number of bare signs.

    Before a colon in mid-sentence it is open how many words belong to the label: then the
    shorter form is its last word. A label is certain at the start and after a stop.
    """
    lead = _LEAD_TIME.match(text)
    base = lead.end() if lead else 0
    body = text[base:]
    labels, at = [], 0
    while m := _LABEL.search(body, at):
        last_at = at
        form = m["bracket"] or m["colon"] or m["dash"]
        before = body[: m.start()].rstrip()
        edge = not before or before[-1] in ".?!…♪*])。:" or bool(m["sign"])
        at = m.end()
        if m["dash"] and not edge:
            continue
        words = form.split()
        if m["bracket"] and SOUNDS.search(form):
            continue
        numbered = words[-1].strip("#").isdigit()
        short = " ".join(words[-2:]) if numbered else words[-1]
        if m["colon"] and len(words) > 1 + numbered and re.search(r"[.?!]$", words[0]) and len(words[0].strip(".?!")) > 1 and words[0].lower().strip(".") not in ("dr", "prof", "mr", "mrs", "ms"):
            form, edge = short, True  # "end of sentence. Name:"
        elif m["colon"] and not edge and (more := _MORE_NAMES.search(body, last_at, m.start())) and not body.isupper():
            form, edge = more[1] + form, True
        name_at = m.start("bracket") - 1 if m["bracket"] else m.end("colon") - len(form) if m["colon"] else m.start("dash")
        short_at = m.end("colon") - len(short) if m["colon"] else name_at
        if m["sign"]:
            name_at = short_at = m.start("sign")
        labels.append((base + name_at, base + m.end(), form, short, edge, base + short_at, bool(m["sign"]) or re.search(r"(?:>>|[-–—])\s*$", body[:name_at]) is not None))
    signs = sum(not any(a <= base + s.end() <= b for a, b, *_ in labels) and not any(base + s.end() == a for a, *_ in labels) for s in _SIGN.finditer(body))
    return labels, signs


def _parse(form: str) -> dict:
    words = [w for w in re.split(r"\s+", form.strip()) if w]
    text = " ".join(words).lower()
    role = re.fullmatch(r"([a-z-]+)\s?#?(\d*)", text)
    if role and role[1] in ROLES:
        return {"role": role[1] + role[2]}
    titled = words[0].lower().strip(".") in ("dr", "prof", "mr", "mrs", "ms") and len(words) > 1
    if titled:
        words = words[1:]
    parts = [re.sub(r"[^\w'’-]", "", w).lower() for w in words]
    parts = [p for p in parts if p]
    if not parts:
        return {}
    if len(parts) == 1:
        return {"last": parts[0]} if titled else {"one": parts[0]}
    return {"first": parts[0], "last": parts[-1]}


def _alike(a: str, b: str) -> bool:
    """Equal names, an initial of the other, or one slipped letter."""
    if a == b:
        return True
    if len(a) == 1 or len(b) == 1:
        return a[0] == b[0]
    return slipped(a, b)


def roster(forms: list[tuple[str, str, bool, int]], chapter_names: list[str]) -> dict[str, str]:
    """form -> speaker of one video, from (form, corrected form, certain, count).

    Full names found in labels and chapters come first; every other form goes to the one it
    fits. Forms found in mid-sentence only make no speaker of their own. At last, a first name
    and a family name without the other are one speaker if an initial says so and of no other.
    """
    people: list[dict] = []
    out: dict[str, dict | str] = {}

    def rank(p: dict, q: dict) -> int:
        first, last = q.get("first", ""), q.get("last", "")
        if "one" in p:
            one = p["one"]
            return 0 if one in (first, last) or one in q["also"] else 1 if any(len(x) > 1 and slipped(one, x) for x in (first, last, *q["also"]) if x) else 9
        if "first" in p:
            fits = (not first or _alike(p["first"], first)) and (not last or _alike(p["last"], last))
            sure = first and last or first and len(first) > 1 and len(p["first"]) > 1 or last and len(last) > 1 and len(p["last"]) > 1
            return 9 if not (fits and sure) else 0 if p["first"] == first and p["last"] == last else 1
        return 0 if p["last"] == last else 1 if len(last) > 1 and slipped(p["last"], last) else 9

    def fit(p: dict) -> dict | None:
        best = min(people, key=lambda q: rank(p, q), default=None)
        return best if best is not None and rank(p, best) < 9 else None

    for p in map(_parse, chapter_names):
        if "first" in p and len(p["first"]) > 1 and not fit(p):
            people.append({"first": p["first"], "last": p["last"], "also": set()})
    parsed = [(f, _parse(c), certain, n) for f, c, certain, n in forms]

    def order(item):
        form, p, certain, n = item
        return (not ("first" in p and len(p["first"]) > 1 and len(p["last"]) > 1), "first" not in p, "last" not in p, not certain, -n, form)

    for form, p, certain, _ in sorted(parsed, key=order):
        if not p:
            continue
        if "role" in p:
            out[form] = "role " + p["role"]
            continue
        q = fit(p)
        if q is None and certain:
            q = {k: v for k, v in p.items() if k in ("first", "last")} | {"also": set()}
            if "one" in p:
                q["family" if form.isupper() and len(p["one"]) > 6 else "first"] = p["one"]
            if "family" in q:
                q["last"] = q.pop("family")
            people.append(q)
        if q is not None:
            if "one" in p:
                q["also"].add(p["one"])
            for k in ("first", "last"):
                if k in p and len(p[k]) > 1 and len(q.get(k, "")) < 2:
                    q[k] = p[k]
            out[form] = q
    _pair_up(people)

    def key(q: dict) -> str:
        while "same" in q:
            q = q["same"]
        return " ".join(x for x in (q.get("first"), q.get("last")) if x)

    return {f: q if isinstance(q, str) else key(q) for f, q in out.items()}


def _pair_up(people: list[dict]) -> None:
    """Mark speakers known by the first name as the same as those known by the family name alone."""
    firsts = [q for q in people if len(q.get("first", "")) > 1 and len(q.get("last", "")) < 2]
    lasts = [q for q in people if len(q.get("last", "")) > 1 and len(q.get("first", "")) < 2]

    def may(a: dict, b: dict) -> bool:
        i, j = b.get("first", ""), a.get("last", "")
        return bool(i or j) and (not i or a["first"][0] == i) and (not j or b["last"][0] == j)

    pairs = [(a, b) for a in firsts for b in lasts if may(a, b)]
    for a, b in pairs:
        if sum(x is a for x, _ in pairs) == 1 and sum(y is b for _, y in pairs) == 1:
            a["last"] = b["last"]
            b["same"] = a


_CHAPTER_NAME = re.compile(r"^(?:Q\s?&\s?A with|Interview(?: with)?:?|With|Guest:?|Speaker:?|Talk by)\s+([A-Z][\w'’-]+ [A-Z][\w'’-]+)|^([A-Z][\w'’-]+ [A-Z][\w'’-]+) (?:on|answers|speaks|talks|explains|presents|joins|about|with)\b", re.I)


def chapter_name(title: str | None) -> str | None:
    """The speaker a chapter's title names."""
    if not title:
        return None
    m = _CHAPTER_NAME.match(_LEAD_TIME.sub("", title.strip()))
    name = (m[1] or m[2]) if m else None
    return None if name is None or name.split()[0].lower() in ("how", "the", "part", "why", "what") else name


def said(text: str) -> list[tuple[str, int]]:
    """Words of a visible cue, as they are compared, and where each ends."""
    return [(_QUIET.sub("", m[0].lower()), m.end()) for m in _SPOKEN_WORD.finditer(text)]


_SPOKEN_WORD = re.compile(r"[^\W_](?:['`’­​-‍⁠﻿]*[^\W_])*")
_QUIET = re.compile(r"['`’­​-‍⁠﻿]")


def _overlap(end: list[str], start: list[str]) -> int:
    """The length of the longest end of the one that begins the other, by the prefix function: linear."""
    line = [*start, None, *end]
    borders = [0] * len(line)
    for i in range(1, len(line)):
        k = borders[i - 1]
        while k and line[i] != line[k]:
            k = borders[k - 1]
        borders[i] = k + (line[i] == line[k])
    return borders[-1] if end else 0


def new_from(before: str | None, text: str) -> int:
    """Where what is new begins in a visible cue: after what it repeats from the end of the one before (two
    words or more), or at its end where it repeats it whole but for slipped letters."""
    old, new = said(before or ""), said(text)
    if not old or not new:
        return 0
    a, b = [w for w, _ in old], [w for w, _ in new]
    if same_words(" ".join(a), " ".join(b)):
        return len(text)
    n = _overlap(a[-len(b) :], b)
    return new[n - 1][1] if n > 1 else 0


def swept(captions: DataFrame) -> DataFrame:
    """Cues once each in sweep order: video_id, c (chunk), i, s, d, text and the text before it.

    Cues are sorted by start within chunks of the given order; a missing start is
    that of the cue before. The first cue of a chunk gets the last text of the
    chunk before from a summary row of each chunk.
    """
    length = F.greatest(F.coalesce(F.when(~F.isnan("duration"), F.col("duration")), F.lit(0.0)), F.lit(0.0))
    cues = captions.where("video_id IS NOT NULL AND seg_idx IS NOT NULL").select("video_id", F.expr(f"cast(seg_idx div {CHUNK} AS long)").alias("c"), F.col("seg_idx").cast("long").alias("i"), F.when(~F.isnan("start"), F.col("start")).alias("s"), length.alias("d"), "text")
    chunk = Window.partitionBy("video_id", "c")
    once = cues.repartition("video_id", "c").groupBy("video_id", "c", "i").agg(F.max(F.struct("s", "d", "text")).alias("v")).select("video_id", "c", "i", "v.*")
    at = once.withColumn("at", F.last("s", True).over(chunk.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    line = chunk.orderBy("at", "i")
    lasts = cues.groupBy("video_id", "c").agg(F.max_by("text", F.struct(F.coalesce("s", F.lit(float("-inf"))), "i")).alias("end"))
    lasts = lasts.select("video_id", "c", F.lag("end").over(Window.partitionBy("video_id").orderBy("c")).alias("end"))
    first = F.row_number().over(line) == 1
    return at.withColumn("before", F.lag("text").over(line)).withColumn("first", first).join(lasts, ["video_id", "c"]).withColumn("before", F.when(F.col("first"), F.col("end")).otherwise(F.col("before"))).drop("at", "first", "end")


_MARK = "video_id string, i long, signs int, k int, form string, short string, certain boolean, a int, a2 int, own int"
_MARKS = pa.schema([("video_id", pa.string()), ("i", pa.int64()), ("signs", pa.int32()), ("k", pa.int32()), ("form", pa.string()), ("short", pa.string()), ("certain", pa.bool_()), ("a", pa.int32()), ("a2", pa.int32()), ("own", pa.int32())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for video, i, text, before in zip(*(batch.column(c).to_pylist() for c in range(4))):
            text = visible(text)
            labels, signs = cue_marks(text)
            if not labels and not signs:
                continue
            new = new_from(visible(before), text)
            if new == len(text):
                continue  # repeated as a whole
            labels = [x for x in labels if x[1] > new]
            if signs and not labels:
                rows.append((video, i, signs, -1, "", "", False, 0, 0, 0))
            rows += [(video, i, signs, k, form, short, edge, a, a2, int(own)) for k, (a, _, form, short, edge, a2, own) in enumerate(labels)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(_MARKS), _MARKS)], schema=_MARKS)


_WHO = pa.schema([("video_id", pa.string()), ("form", pa.string()), ("short", pa.string()), ("speaker", pa.string()), ("by_form", pa.bool_()), ("opener", pa.bool_()), ("alone", pa.bool_())])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct marks of a video to speakers, and whether its signs stand alone: more bare signs than labels."""
    for batch in batches:
        rows = []
        for video, marks, titles in zip(*(batch.column(c).to_pylist() for c in range(3))):
            forms: dict[str, list] = {}
            for x in marks:
                if x["form"] and not x["opener"]:
                    # a label of more than two words is certain once it comes again
                    certain = x["certain"] and (len(x["form"].split()) < 3 or x["n"] > 1 or x["form"].lower().startswith(("dr", "prof", "mr", "ms")))
                    f = forms.setdefault(x["form"], [x["form_c"], False, 0])
                    f[1], f[2] = f[1] or certain, f[2] + (x["n"] if certain else 0)
                    forms.setdefault(x["short"], [x["short_c"], False, 0])
            who = roster([(f, c, certain, n) for f, (c, certain, n) in sorted(forms.items())], [n for n in map(chapter_name, titles or []) if n])
            known = lambda x: not x["opener"] and (x["form"] in who or x["short"] in who)
            labels = sum(x["n"] for x in marks if x["form"] and known(x))
            alone = sum(x["signs"] + x["own"] * x["opener"] for x in marks) > labels  # an opener's sign is a bare one
            rows += [(video, x["form"], x["short"], None if x["opener"] else who.get(x["form"]) or who.get(x["short"]), x["form"] in who, x["opener"], alone) for x in marks]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(_WHO), _WHO)], schema=_WHO)


def _spelled(forms: DataFrame) -> DataFrame:
    """(form, corrected) of (form, n): labels in lower case, slipped names replaced by what is frequent in all videos."""
    words = forms.select("form", "n", F.posexplode(F.split(F.lower("form"), r"\s+")).alias("p", "token"))
    tokens = words.groupBy("token").agg(F.sum("n").alias("n")).select(F.lit("label").alias("role"), "token", "n", F.lit(4).alias("ratio"))
    fixed = words.join(slips(tokens).drop("role"), "token", "left")
    return fixed.groupBy("form").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", F.coalesce("canon", "token").alias("t")))), lambda x: x["t"]), " ").alias("corrected"))


def _openers(kinds: DataFrame, chapters: DataFrame) -> DataFrame:
    """Words of labels (``word``) that are openers: over all videos they often stand after another label in one
    cue, or the labels begin the chapter titles of many videos."""
    titles = chapters.where("video_id IS NOT NULL").select("video_id", F.regexp_extract(F.lower("title"), r"^\s*(?:[\[(]?\d+(?::\d+)+[\])]?\s*)?([^:]{1,60}?)\s*:", 1).alias("begin")).distinct()
    usual = titles.groupBy("begin").agg(F.count("*").alias("videos")).crossJoin(F.broadcast(titles.agg(F.count_distinct("video_id").alias("of")))).where((F.col("begin") != "") & (F.col("videos") > 1) & (F.col("videos") >= TITLES * F.col("of"))).select("begin", F.lit(1).alias("titled"))
    per = kinds.where("word <> ''").withColumn("begin", F.lower("form")).join(usual, "begin", "left").groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("titled") == 1, F.col("n")).otherwise(F.col("after"))).alias("after"))
    believed = F.when(F.col("word").isin(sorted(OPENERS)), LISTED).otherwise(0.0) * BELIEF
    return per.where((F.col("after") + believed) / (F.col("n") + BELIEF) >= OPENER).select("word", F.lit(True).alias("opener"))


def speaker_changes(captions: DataFrame, chapters: DataFrame, cues: DataFrame | None = None) -> DataFrame:
    """(video_id, seg_idx, at, speaker): where turns begin, with the place in the cue's visible text.

    Null or blank cues carry no mark; re-delivered rows count once; a repeated
    cue, or the part of it that is repeated, begins no turn; a video without
    labels and signs gives no row. Speakers of videos with signs alone have no
    name (null). ``cues``: the swept captions, where they are at hand.
    """
    cues = swept(captions) if cues is None else cues
    marked = cues.where(F.col("text").rlike(r":|\[|\(|>>|(?i)&gt;|&amp;gt;|&#|^\s*(?:<[^>]*>)?\s*[-\x{2013}\x{2014}]|\s[-\x{2013}\x{2014}]\s"))
    marks = cut(marked.select("video_id", "i", "text", "before").mapInArrow(_read, _MARK))
    # the distinct labels of a video are few, whatever its length; a cue's signs count with its first mark
    kinds = cut(marks.groupBy("video_id", "form", "short").agg(F.max("certain").alias("certain"), F.count("*").alias("n"), F.sum((F.col("k") > 0).cast("int")).alias("after"), F.sum(F.when(F.col("k") <= 0, F.col("signs")).otherwise(0)).alias("signs"), F.sum("own").alias("own")))
    spelled = cut(_spelled(kinds.select(F.explode(F.array("form", "short")).alias("form")).where("form <> ''").groupBy("form").agg(F.count("*").alias("n"))))
    titles = chapters.where("video_id IS NOT NULL AND title IS NOT NULL").groupBy("video_id").agg(F.sort_array(F.collect_set("title")).alias("titles"))
    each = kinds.join(spelled.withColumnRenamed("corrected", "form_c"), "form", "left").join(spelled.select(F.col("form").alias("short"), F.col("corrected").alias("short_c")), "short", "left")
    # a label goes by its last word, not counting a number after it, or by a first word that usually opens ("Part two")
    first, last = F.regexp_extract("form_c", r"^([^\W\d_]+)", 1), F.regexp_extract("form_c", r"([^\W\d_]+)[\W\d_]*$", 1)
    each = cut(each.withColumn("word", F.coalesce(F.when(first.isin("part", "chapter", "section", "step", "see"), first).otherwise(last), F.lit(""))))
    each = each.join(_openers(each, chapters), "word", "left").withColumn("opener", F.coalesce("opener", F.lit(False)))
    videos = each.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("form", "short", "form_c", "short_c", "certain", "n", "signs", "own", "opener"))).alias("marks")).join(titles, "video_id", "left")
    who = videos.select("video_id", "marks", "titles").mapInArrow(_resolve, "video_id string, form string, short string, speaker string, by_form boolean, opener boolean, alone boolean")
    said_by = cut(marks.join(who, ["video_id", "form", "short"]).select("video_id", "i", "k", (F.col("signs") + F.when(F.col("opener"), F.col("own")).otherwise(0)).alias("signs"), "alone", "speaker", F.when(F.col("by_form"), F.col("a")).otherwise(F.col("a2")).alias("a")))
    # the speaker before: within a chunk by the order, over chunks by their last speakers
    part = said_by.where("NOT alone AND speaker IS NOT NULL").withColumn("c", F.floor(F.col("i") / CHUNK))
    inside = Window.partitionBy("video_id", "c").orderBy("i", "k")
    part = part.withColumn("was", F.lag("speaker").over(inside)).withColumn("last", F.last("speaker").over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("first", F.row_number().over(inside) == 1)
    heads = part.where("first").select("video_id", "c", F.lag("last").over(Window.partitionBy("video_id").orderBy("c")).alias("before"))
    part = part.join(heads, ["video_id", "c"]).withColumn("was", F.coalesce("was", "before"))
    changes = part.where(F.col("was").isNull() | (F.col("was") != F.col("speaker"))).select("video_id", "i", "a", "speaker")
    signed = said_by.where("alone AND signs > 0").select("video_id", "i", F.lit(0).alias("a"), F.lit(None).cast("string").alias("speaker")).distinct()
    return changes.unionByName(signed).select("video_id", F.col("i").cast("int").alias("seg_idx"), F.col("a").alias("at"), "speaker")


def clean(text: str) -> str:
    """Spoken words: without labels' remains, times, sounds and fillers."""
    text = _SOUND_MARK.sub(lambda m: " " if m[1] is None or SOUNDS.search(m[1]) or _TIME.fullmatch(m[0]) else m[0], text)
    text = re.sub(r"[\[(]\d{1,2}:\d{2}(?::\d{2})?[\])]", " ", _LEAD_TIME.sub("", text))
    text = re.sub(r"^\s*(?:>>+|[-–—])\s*", "", text)
    text = _FILLER.sub("", text)
    return re.sub(r"\s+([,.?!])", r"\1", re.sub(r"\s+", " ", text)).strip()


_PIECES = pa.schema([("video_id", pa.string()), ("i", pa.int64()), ("k", pa.int32()), ("speaker", pa.string()), ("opens", pa.bool_()), ("s", pa.float64()), ("e", pa.float64()), ("text", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cues to the pieces of turns they hold. A repeated cue gives an empty piece, as it is spoken until its end."""
    for batch in batches:
        rows = []
        for video, i, text, before, s, e, changes in zip(*(batch.column(c).to_pylist() for c in range(7))):
            text = visible(text)
            new = new_from(visible(before), text)
            cuts = {x["at"]: x["speaker"] for x in changes or []}
            if text and new == len(text) and not cuts:
                rows.append((video, i, 0, None, False, s, e, ""))
                continue
            labels, _ = cue_marks(text)
            at, k, speaker, opens, kept = new, 0, None, False, ""
            for a, b, _, _, edge, a2, _ in [*labels, (len(text), len(text), "", "", True, len(text), False)]:
                a = a if a in cuts or edge and a2 not in cuts else a2
                kept += text[at : max(at, a)]
                if a in cuts and a < len(text):
                    if clean(kept):
                        rows.append((video, i, k, speaker, opens, s, e, clean(kept)))
                        k, kept, opens = k + 1, "", False
                    speaker, opens, kept = cuts[a], True, ""
                at = max(at, b)
            if 0 in cuts and not opens and k == 0:
                speaker, opens = cuts[0], True
            if clean(kept) or opens:
                rows.append((video, i, k, speaker, opens, s, e, clean(kept)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(_PIECES), _PIECES)], schema=_PIECES)


def speaker_turns(captions: DataFrame, chapters: DataFrame) -> DataFrame:
    """(video_id, turn_no, part, speaker, first_idx, start, end_time, text) of every video with spoken words.

    A turn that goes on over several chunks of CHUNK cues comes in as many parts,
    so that no row grows with a video. Text before the first mark, and all of a
    video without marks, is turn 0 without a speaker and is split at pauses: gaps
    of PAUSE seconds or more that pass the upper quartile of the video's gaps by
    three times the range between quartiles.
    """
    cues = cut(swept(captions))
    changes = speaker_changes(captions, chapters, cues)
    at = changes.groupBy("video_id", F.col("seg_idx").cast("long").alias("i")).agg(F.sort_array(F.collect_list(F.struct("at", "speaker"))).alias("x"))
    pieces = cues.where("text IS NOT NULL").join(at, ["video_id", "i"], "left").select("video_id", "i", "text", "before", "s", (F.col("s") + F.col("d")).alias("e"), "x").mapInArrow(_pieces, "video_id string, i long, k int, speaker string, opens boolean, s double, e double, text string")
    part = pieces.withColumn("c", F.floor(F.col("i") / CHUNK))
    inside = Window.partitionBy("video_id", "c").orderBy("i", "k")
    past = Window.partitionBy("video_id").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    part = cut(part.withColumn("n", F.sum(F.col("opens").cast("int")).over(inside)).withColumn("until", F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1))))
    per_chunk = part.groupBy("video_id", "c").agg(F.sum(F.col("opens").cast("int")).alias("m"), F.max("e").alias("e"))
    offset = per_chunk.select("video_id", "c", F.coalesce(F.sum("m").over(past), F.lit(0)).alias("o"), F.max("e").over(past).alias("before"))
    marked = part.join(offset, ["video_id", "c"]).withColumn("marks", F.col("n") + F.col("o")).withColumn("gap", F.col("s") - F.greatest("until", "before"))
    marked = cut(marked.drop("n", "o", "until", "before"))
    quartile = F.percentile_approx("gap", F.array(F.lit(0.25), F.lit(0.75)), 1000)
    limits = marked.where("k = 0 AND gap IS NOT NULL").groupBy("video_id").agg(quartile.alias("q")).select("video_id", (F.col("q")[1] + 3 * (F.col("q")[1] - F.col("q")[0])).alias("limit"))
    pause = (F.col("marks") == 0) & (F.col("gap") >= PAUSE) & (F.col("gap") > F.col("limit")) & (F.col("text") != "")
    paused = marked.join(limits, "video_id", "left").withColumn("paused", F.coalesce(pause, F.lit(False)).cast("int")).withColumn("p", F.sum("paused").over(inside))
    pauses = paused.groupBy("video_id", "c").agg(F.sum("paused").alias("m")).select("video_id", "c", F.coalesce(F.sum("m").over(past), F.lit(0)).alias("o"))
    numbered = cut(paused.join(pauses, ["video_id", "c"]).select("video_id", (F.col("marks") + F.col("p") + F.col("o")).cast("int").alias("turn_no"), "c", "i", "k", "speaker", "s", "e", "text"))
    by = numbered.where("speaker IS NOT NULL").groupBy("video_id", "turn_no").agg(F.max("speaker").alias("speaker"))
    words = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("i", "k", "text"))), lambda x: x["text"]), lambda t: t != "")
    parts = numbered.groupBy("video_id", "turn_no", "c").agg(F.min("i").cast("int").alias("first_idx"), F.min("s").alias("start"), F.max("e").alias("end_time"), F.array_join(words, " ").alias("text"))
    order = Window.partitionBy("video_id", "turn_no").orderBy("c")
    return parts.join(by, ["video_id", "turn_no"], "left").select("video_id", "turn_no", (F.row_number().over(order) - 1).alias("part"), "speaker", "first_idx", "start", "end_time", "text")


def found(captions: DataFrame, chapters: DataFrame) -> DataFrame:
    return speaker_changes(captions, chapters).select("video_id", F.col("seg_idx").alias("first_idx")).distinct()
