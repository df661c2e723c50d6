"""Section trees and slices of Markdown and plain text."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.sources.tables import spread

MOST_LINE_CHARS = 1_000_000
# a fenced block as a whole: up to the same mark, at least as long; without one, to the end of the text
_FENCED = re.compile(r"^(`{3,}|~{3,})[\s\S]*?(?:^\1(?:(?<=`)`*|(?<=~)~*)(?P<closed>)|\Z)", re.M)
_HEADING = re.compile(r"^(#{1,6})[^\S\n]+(.+)$", re.M)
_BLANKS = dict.fromkeys((0xA0, *range(0x2000, 0x200C), 0x202F, 0x205F, 0x3000, 0xFEFF), " ")


def fenced_ranges(text: str) -> list[tuple[int, int]]:
    """Spans of fenced code; a fence left open is none."""
    return [m.span() for m in _FENCED.finditer(text) if m["closed"] is not None]


def sections_in(text: str) -> list[tuple[str, int, int, int, bool]]:
    """(name, level, start, end, header only) of each heading outside code; names of one character are none."""
    borders = [x for span in fenced_ranges(text) for x in span]
    heads = [m for m in _HEADING.finditer(text) if bisect_right(borders, m.start()) % 2 == 0]
    named = [(m, _shown(m[2])) for m in heads]
    named = [(m, name) for m, name in named if len(name) > 1]
    starts = [m.start() for m, _ in named] + [len(text)]
    return [(name, len(m[1]), a, b, text[m.end() : b].isspace() or m.end() == b) for (m, name), (a, b) in zip(named, pairwise(starts))]


def _shown(name: str) -> str:
    """A heading's text with plain blanks for all blanks and for what can't be printed."""
    name = name.strip().translate(_BLANKS)
    return (name if name.isprintable() else "".join(c if c.isprintable() else " " for c in name)).strip()


def _rows(fn, schema: pa.Schema):
    """mapInArrow over (key, text): fn gives the rows of one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *r) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t is not None for r in fn(t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)], schema=schema)

    return run


_SECTIONS = pa.schema([("key", pa.int64()), ("idx", pa.int32()), ("name", pa.string()), ("level", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("header_only", pa.bool_())])


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Section rows of each text; texts without headings, and null texts, have none."""
    fn = _rows(lambda t: [(i, *s) for i, s in enumerate(sections_in(t))], _SECTIONS)
    return spread(docs.select(F.col(key).cast("long"), text)).mapInArrow(fn, f"`{key}` long, idx int, name string, level int, start_pos int, end_pos int, header_only boolean")


def _levels(key: str, order: str, value: str, following: bool = False) -> list[Column]:
    """For each level the nearest earlier (or later) section's value."""
    w = Window.partitionBy(key).orderBy(order)
    w = w.rowsBetween(1, Window.unboundedFollowing) if following else w.rowsBetween(Window.unboundedPreceding, -1)
    take = F.first if following else F.last
    return [take(F.when(F.col("level") == lv, F.col(value)), ignorenulls=True).over(w) for lv in range(1, 7)]


def with_parents(secs: DataFrame, key: str, order: str) -> DataFrame:
    """Adds parent: the nearest earlier section of a smaller level. Windows over each level replace a self-join."""
    last = _levels(key, order, order)
    parent = F.greatest(*[F.when(F.col("level") > lv, last[lv - 1]) for lv in range(1, 7)], F.lit(None).cast("int"))
    return secs.withColumn("parent", parent)


def with_subtree_end(secs: DataFrame, key: str, order: str) -> DataFrame:
    """Adds subtree_end: the start of the next section of the same or a smaller level, else the last end."""
    nxt = _levels(key, order, "start_pos", following=True)
    last = F.last("end_pos").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    end = F.least(*[F.when(F.col("level") >= lv, nxt[lv - 1]) for lv in range(1, 7)], F.lit(None).cast("int"))
    return secs.withColumn("subtree_end", F.coalesce(end, last))


def with_ancestry(secs: DataFrame, key: str, order: str) -> DataFrame:
    """Adds ancestry, as in Background > Context. The ancestor at a level is the last section of that
    level, unless a section of a smaller level has come since."""
    at, names = _levels(key, order, order), _levels(key, order, "name")
    marked = secs.select("*", *[c.alias(f"_i{k}") for k, c in enumerate(at, 1)], *[c.alias(f"_n{k}") for k, c in enumerate(names, 1)])
    parts = []
    for lv in range(1, 7):
        newer = F.greatest(*[F.col(f"_i{m}") for m in range(1, lv)], F.lit(None).cast("int"), F.lit(None).cast("int"))
        parts.append(F.when((F.col("level") > lv) & F.col(f"_i{lv}").isNotNull() & (F.col(f"_i{lv}") > F.coalesce(newer, F.lit(-1))), F.col(f"_n{lv}")))
    return marked.withColumn("ancestry", F.concat_ws(" > ", *parts, "name")).drop(*[f"_{x}{k}" for x in "in" for k in range(1, 7)])


def table_of_contents(secs: DataFrame, key: str, order: str) -> DataFrame:
    """Adds line: the indented entry, with the parent's name where a name repeats."""
    per = Window.partitionBy(key)
    s = with_parents(secs, key, order)
    names = s.select(F.col(key), F.col(order).alias("parent"), F.col("name").alias("parent_name"))
    s = s.withColumn("_least", F.min("level").over(per)).withColumn("_same", F.count("*").over(Window.partitionBy(key, "name"))).join(names, [key, "parent"], "left")
    shown = F.when((F.col("_same") > 1) & F.col("parent_name").isNotNull(), F.concat("name", F.lit(" ("), "parent_name", F.lit(")"))).otherwise(F.col("name"))
    return s.withColumn("line", F.concat(F.repeat(F.lit("  "), F.col("level") - F.col("_least")), F.lit("- "), shown, F.when(F.col("header_only"), F.lit(" [header only]")).otherwise(F.lit("")))).drop("_least", "_same")


def contents_page(total: Column, index: Column, size: int = 100) -> Column:
    """Struct start, page, pages, clamped_from of a page of the contents; negative indexes count from the end."""
    pages = F.ceil(total / size)
    real = F.when(index < 0, pages + index).otherwise(index)
    page = F.greatest(F.least(real, pages - 1), F.lit(0))
    clean = (real >= 0) & (real < pages)
    out = F.struct((page * size).cast("bigint").alias("start"), page.cast("bigint").alias("page"), pages.cast("bigint").alias("pages"), F.when(~clean, index).cast("bigint").alias("clamped_from"))
    none = F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("page"), F.lit(0).cast("bigint").alias("pages"), F.lit(None).cast("bigint").alias("clamped_from"))
    return F.when(total <= 0, none).otherwise(out)


def line_chunks(text: str, size: int = 1800) -> list[tuple[int, int, str]] | None:
    """(index, offset, text) of runs of whole lines up to size; None if a line is beyond all bounds.

    The ends of the lines are prefix sums; each run ends at the last of them within size of its start,
    or at the first if that is a longer line.
    """
    ends = [m.end() for m in re.finditer("\n", text)]
    if text and not text.endswith("\n"):
        ends.append(len(text))
    if any(b - a > MOST_LINE_CHARS for a, b in pairwise([0, *ends])):
        return None
    out, start = [], 0
    while start < len(text):
        k = max(bisect_right(ends, start + size) - 1, bisect_right(ends, start))
        out.append((len(out), start, text[start : ends[k]]))
        start = ends[k]
    return out


_SEAMS = [re.compile(p, re.M) for p in (r"^(?=#{1,2}\s)", r"^(?=#{3,6}\s)", r"\n[ \t]*\n+", r"\n", r"(?<=[.!?。])\s+", r"\s+")]


def semantic_chunks(text: str, low: int = 1600, high: int = 2000) -> list[tuple[int, int, str]] | None:
    """(index, offset, text) of pieces of at most high characters, cut at the strongest seam in reach:
    headings, paragraphs, lines, sentences, words. Pieces are packed up to low before a weak seam ends
    one. None if a line is beyond all bounds; joined, the pieces are the text."""
    if max((len(x) for x in text.split("\n")), default=0) > MOST_LINE_CHARS:
        return None
    out, a, n = [], 0, len(text)
    seams = [[m.end() for m in p.finditer(text)] for p in _SEAMS]
    at = [0] * len(seams)
    while a < n:
        if n - a <= high:
            b = n
        else:
            b = a + high
            for k, seam in enumerate(seams):
                while at[k] < len(seam) and seam[at[k]] <= a:
                    at[k] += 1
                j = at[k]
                best = None
                while j < len(seam) and seam[j] <= a + high:
                    if seam[j] - a >= (low if k > 1 else high // 3):
                        best = seam[j]
                    j += 1
                if best:
                    b = best
                    break
        out.append((len(out), a, text[a:b]))
        a = b
    return out


_CHUNKS = pa.schema([("key", pa.int64()), ("idx", pa.int32()), ("off", pa.int32()), ("text", pa.string())])


SPLITTERS = {"semantic": semantic_chunks, "lines": line_chunks}


def register_splitter(name: str, split) -> None:
    """Make a splitter of one's own known to ``chunks``: it gives (index, offset, text) of one text's slices, or None."""
    SPLITTERS[name] = split


def chunks(docs: DataFrame, key: str, text: str, how: str = "semantic") -> DataFrame:
    """Slices (idx, off, text) of each text. Texts with a line of over a million characters have none."""
    split = SPLITTERS[how]
    return spread(docs.select(F.col(key).cast("long"), text)).mapInArrow(_rows(lambda t: split(t) or [], _CHUNKS), f"`{key}` long, idx int, off int, text string")


# fixed values: headings that begin a comment, a post, and a comment or file of an issue
MARKS = {"comments": r"^#{3,6} \S+$", "posts": r"^### \d+$", "issues": r"^#{2,6} (?:ic_|rc_|\S+\.\S+)"}


def marked_posts(docs: DataFrame, key: str, text: str, kind: str = "comments") -> DataFrame:
    """(key, idx, off, text): a thread cut before each heading of its kind; what stands before the first is slice 0."""
    mark = re.compile(MARKS[kind], re.M)

    def split(t: str):
        starts = [m.start() for m in mark.finditer(t)] or [0]
        starts = starts if starts[0] == 0 else [0, *starts]
        return [(i, a, t[a:b].rstrip()) for i, (a, b) in enumerate(pairwise([*starts, len(t)]))]

    return spread(docs.select(F.col(key).cast("long"), text)).mapInArrow(_rows(split, _CHUNKS), f"`{key}` long, idx int, off int, text string")


def slice_ancestry(slices: DataFrame, secs: DataFrame, key: str) -> DataFrame:
    """(key, idx, ancestry): each slice's innermost section by a backward as-of join, with (n/m) where
    several slices in a row lie in one section. The join is a union sorted by offset: no range join."""
    s = with_ancestry(secs, key, "idx").select(key, F.col("start_pos").alias("off"), F.lit(0).alias("what"), F.col("idx").alias("sec"), "ancestry", F.lit(None).cast("int").alias("slice"))
    c = slices.select(key, "off", F.lit(1).alias("what"), F.lit(None).cast("int").alias("sec"), F.lit(None).cast("string").alias("ancestry"), F.col("idx").alias("slice"))
    back = Window.partitionBy(key).orderBy("off", "what", "sec", "slice").rowsBetween(Window.unboundedPreceding, 0)
    joined = s.unionByName(c).withColumn("sec", F.last("sec", True).over(back)).withColumn("ancestry", F.last("ancestry", True).over(back)).where("what = 1")
    # a slice's section never comes back once left, as both are in order: a run is a section's slices
    run = Window.partitionBy(key, "sec")
    n, m = F.row_number().over(run.orderBy("slice")), F.count("*").over(run)
    shown = F.when(F.col("sec").isNull(), "").when(m > 1, F.concat("ancestry", F.lit(" ("), n.cast("string"), F.lit("/"), m.cast("string"), F.lit(")"))).otherwise(F.col("ancestry"))
    return joined.select(key, F.col("slice").alias("idx"), shown.alias("ancestry"))


def within_budget(rows: DataFrame, key: str, order: str, size: Column, budget: int) -> DataFrame:
    """Rows of each key kept until the first that would pass the budget; the first row always stays."""
    w = Window.partitionBy(key).orderBy(order)
    used = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    over = (used > budget) & (F.row_number().over(w) > 1)
    return rows.withColumn("_o", over.cast("int")).withColumn("_over", F.max("_o").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_over = 0").drop("_o", "_over")


def line_range(docs: DataFrame, key: str, text: str, first: int, last: int) -> DataFrame:
    """(key, line_no, line) of lines first to last, counted from 1, both included."""
    lines = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("p", "line"))
    return lines.where(F.col("p").between(first - 1, last - 1)).select(key, (F.col("p") + 1).alias("line_no"), "line")


def hard_cut(text: Column, tokens: int) -> Column:
    """Struct shown, hint of a text cut at four characters a token."""
    n = F.length(text)
    kb = F.format_string("%.1f", F.bround(n / 1024, 1))  # half to even
    hint = F.concat(F.lit("Full page is "), kb, F.lit(" KB (~"), F.format_number(F.floor(n / 4), 0), F.lit(f" tokens), showing first ~{tokens:,} tokens. Use max_tokens to adjust."))
    return F.struct(F.left(text, F.lit(tokens * 4)).alias("shown"), F.when(n > tokens * 4, hint).alias("hint"))


def packed_prefix(parts: list[str], budget: int) -> int:
    """How many pieces fit: the first always, and one beyond the budget while less than half is used.

    In sums: the cut is at the first sum over the budget whose predecessor is half of it or more.
    """
    sums = list(accumulate(map(len, parts)))
    over = max(bisect_right(sums, budget), bisect_left(sums, budget // 2) + 1, 1)
    return min(over, len(parts))


def packed(pieces: DataFrame, key: str, order: str, size: Column, budget: int) -> DataFrame:
    """The pieces of each text that packed_prefix keeps, by running sums, with whether any was left out."""
    w = Window.partitionBy(key).orderBy(order)
    used = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = pieces.withColumn("_u", used).withColumn("_s", F.col("_u") + size)
    s = s.withColumn("_keep", (F.row_number().over(w) == 1) | (F.col("_s") <= budget) | (F.col("_u") < budget // 2))
    return s.withColumn("cut", F.min("_keep").over(Window.partitionBy(key)) == False).where("_keep").drop("_u", "_s", "_keep")  # noqa: E712


def entries_within(entries: DataFrame, key: str, order: str, size: Column, budget: int) -> DataFrame:
    """Whole entries of each key with a joining character between them until one would pass the budget, the first
    always kept; ``kept`` tells which."""
    w = Window.partitionBy(key).orderBy(order)
    n = F.row_number().over(w)
    used = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) + n - 1
    return entries.withColumn("_n", n).withColumn("_used", used).withColumn("kept", (F.col("_n") == 1) | (F.max("_used").over(w.rowsBetween(Window.unboundedPreceding, 0)) <= budget)).drop("_n", "_used")


def matched_sections(secs: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """(key, req, idx, tier): requested names to sections. Tier 0 display name (the last section of a name
    wins), 1 raw name or name without number (the first wins), 2 slug, 3 slug of the decoded request.
    Requests that match nothing come out with a null idx."""
    from sheaf.functions.text import slug, without_number

    toc = table_of_contents(secs, key, "idx")
    shown = F.regexp_replace(F.regexp_replace("line", r"^\s*- ", ""), r" \[header only\]$", "")
    stripped = without_number(F.col("name"))
    ways = F.array(
        F.struct(shown.alias("k"), F.lit(0).alias("tier"), (-F.col("idx")).alias("o")),
        F.struct(F.col("name").alias("k"), F.lit(1).alias("tier"), F.col("idx").alias("o")),
        F.struct(F.nullif(stripped, F.lit("")).alias("k"), F.lit(1).alias("tier"), F.col("idx").alias("o")),
        F.struct(F.nullif(slug(F.col("name")), F.lit("")).alias("k"), F.lit(2).alias("tier"), F.col("idx").alias("o")),
        F.struct(F.nullif(slug(stripped), F.lit("")).alias("k"), F.lit(2).alias("tier"), F.col("idx").alias("o")),
    )
    names = toc.select(key, "idx", F.explode(ways).alias("w")).select(key, "idx", "w.*").where("k IS NOT NULL")
    asked = requests.select(key, "req", F.explode(F.array(F.struct(F.col("req").alias("k"), F.lit(0).alias("x")), F.struct(slug(F.try_url_decode(F.col("req"))).alias("k"), F.lit(3).alias("x")))).alias("a")).select(key, "req", "a.*")
    hits = asked.join(names, [key, "k"]).where("x = 0 OR tier = 2")
    best = hits.groupBy(key, "req").agg(F.min_by(F.struct("idx", F.greatest("tier", "x").alias("tier")), F.struct(F.greatest("tier", "x"), "o")).alias("m"))
    return requests.join(best, [key, "req"], "left").select(key, "req", "m.idx", "m.tier")
