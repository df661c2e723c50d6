"""Splitting oversized sections at natural boundaries (problem 1).

Content-defined chunking: a polynomial rolling hash over the last WINDOW code
points marks landmarks; a landmark snaps to the nearest natural boundary
(paragraph, line, sentence, word). A piece ends at the first snapped landmark
between the least and the largest size, so an edit moves only the pieces next
to it. Consecutive pieces share up to ``overlap`` characters, and no piece
reaches out of its section.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.sources.tables import latest

MAX_CHARS = 2000
OVERLAP = 200
MIN_CORE = 900
WINDOW = 32
EVERY = 256  # a landmark about every so many characters
SNAP = 80  # a landmark moves no farther than this

_BREAKS = re.compile(r"(\n[ \t\r]*\n\s*)|(\n)|([.!?…][\"'”’)\]]*\s+|[。！？]+)|(\s+)")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def landmarks(text: str) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW code points is a landmark."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < WINDOW:
        return np.empty(0, dtype=np.int64)
    total = np.zeros(len(codes) - WINDOW + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):
            total = total * _FACTOR + codes[i : i + len(total)]
        mixed = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    hit = (mixed >> np.uint64(40)) % np.uint64(EVERY) == 0
    return np.flatnonzero(hit).astype(np.int64) + WINDOW


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a piece may end, and their rank: 3 paragraph, 2 line, 1 sentence, 0 word."""
    at, rank = [], []
    for m in _BREAKS.finditer(text):
        at.append(m.end())
        rank.append(4 - m.lastindex)
    return np.array(at, dtype=np.int64), np.array(rank, dtype=np.int64)


def cut_points(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Pieces (start, end) of the text; one if it is short enough.

    A hard cut in mid-word happens only where no boundary lies in reach.
    """
    n = len(text)
    if n <= max_chars:
        return [(0, n)]
    core = max_chars - overlap
    least = min(MIN_CORE, core // 2)
    at, rank = boundaries(text)
    marks = landmarks(text)
    snapped = _snap(marks, at, rank)
    ends, start = [], 0
    while n - start > core:
        low, high = start + least, start + core
        i = np.searchsorted(snapped, low)
        if i < len(snapped) and snapped[i] <= high:
            end = int(snapped[i])
        else:
            a, b = np.searchsorted(at, low), np.searchsorted(at, high, side="right")
            if b > a:
                best = rank[a:b].max()
                end = int(at[a:b][rank[a:b] == best][-1])
            else:
                end = high
        ends.append(end)
        start = end
    ends.append(n)
    pieces, begin = [], 0
    for k, end in enumerate(ends):
        if k:
            left = ends[k - 1] - overlap
            a, b = np.searchsorted(at, left), np.searchsorted(at, ends[k - 1])
            if b > a:
                best = rank[a:b].max()
                begin = int(at[a:b][rank[a:b] == best][0])
            else:
                begin = max(left, 0)
            if end - begin > max_chars:
                begin = end - max_chars
        pieces.append((begin, end))
    return pieces


def _snap(marks: np.ndarray, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Each landmark's nearest boundary, a higher rank first; landmarks without one in reach are dropped."""
    out = []
    for m in marks:
        a, b = np.searchsorted(at, m - SNAP), np.searchsorted(at, m + SNAP, side="right")
        if b > a:
            near = at[a:b]
            out.append(int(near[np.lexsort((np.abs(near - m), -rank[a:b]))[0]]))
    return np.unique(np.array(out, dtype=np.int64))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("section_no", pa.int32()), ("level", pa.int32()), ("piece_no", pa.int32()), ("pieces", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("text", pa.string())])


def _split(max_chars: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for span in spans:
                    body = text[span["start"] : span["end"]]
                    if len(body) <= max_chars:
                        continue
                    pieces = cut_points(body, max_chars, overlap)
                    for k, (a, b) in enumerate(pieces):
                        rows.append((doc_id, span["section_no"], span["level"], k, len(pieces), span["start"] + a, span["start"] + b, body[a:b]))
            columns = list(zip(*rows)) or [()] * len(_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)

    return run


def split_sections(documents: DataFrame, sections: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the sections longer than max_chars.

    Defined cases: re-delivered sections count once; a null end_pos, or one past
    the end, ends with the text; a null or negative start_pos counts as 0; a
    section that starts past the end, or whose document is missing, null or
    empty, gives no piece. Spans are gathered per document before the join, so
    a text is shuffled once at most, and only texts longer than the limit are.
    """
    docs = documents.select("doc_id", "text").where(F.length("text") > max_chars)
    one = latest(sections, ["doc_id", "section_no"], "extracted_at", ["level", "start_pos", "end_pos"])
    spans = (
        one.withColumn("start", F.greatest(F.coalesce("start_pos", F.lit(0)), F.lit(0)))
        .where(F.col("end_pos").isNull() | (F.col("end_pos") - F.col("start") > max_chars))
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("section_no", "level", "start", F.col("end_pos").alias("end")))).alias("spans"))
    )
    return docs.join(spans, "doc_id").select("doc_id", "text", "spans").mapInArrow(
        _split(max_chars, overlap), "doc_id long, section_no int, level int, piece_no int, pieces int, start_pos int, end_pos int, text string"
    )


def found(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """The sections that had to be split."""
    return split_sections(documents, sections).where("piece_no = 0 AND pieces > 1").select("doc_id", "section_no")


def piece_checks(documents: DataFrame, sections: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, section_no, sized, ordered, shared, whole) of each split section: whether its pieces keep within the
    limit, come in order, share up to ``overlap`` characters and, joined without what they share, are the section."""
    p = split_sections(documents, sections, max_chars, overlap)
    per = Window.partitionBy("doc_id", "section_no").orderBy("piece_no")
    before = F.lag("end_pos").over(per)
    p = p.select("*", before.alias("before"), F.lag("start_pos").over(per).alias("begun"))
    fresh = F.substring("text", F.coalesce(F.col("before") - F.col("start_pos"), F.lit(0)) + 1, F.length("text"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_no", fresh.alias("t")))), lambda x: x["t"]), "")
    # a section's pieces make up one text of a document
    out = p.groupBy("doc_id", "section_no").agg(
        F.max(F.length("text")).alias("longest"),
        F.min(F.coalesce((F.col("start_pos") > F.col("begun")) & (F.col("end_pos") > F.col("before")), F.lit(True))).alias("ordered"),
        F.min(F.coalesce((F.col("before") - F.col("start_pos")).between(0, overlap), F.lit(True))).alias("shared"),
        F.min("start_pos").alias("a"),
        F.max("end_pos").alias("b"),
        joined.alias("joined"),
    )
    texts = documents.select("doc_id", F.col("text").alias("source"))
    same = F.col("joined") == F.substring("source", F.col("a") + 1, F.col("b") - F.col("a"))
    return out.join(texts, "doc_id").select("doc_id", "section_no", (F.col("longest") <= max_chars).alias("sized"), "ordered", "shared", same.alias("whole"), (F.col("b") - F.col("a")).alias("chars"))
