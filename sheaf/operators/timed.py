"""Timed segments: gaps, windows, chapters, renderings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: seconds of the window band and of pauses, sentence density of punctuated captions
SHORTEST, LONGEST, PAUSE, DENSITY = 25.0, 35.0, 1.0, 0.05
GAPS, TIMES_MEDIAN, LEAST_OUTLIER, FIXED_OUTLIER = 10, 2.0, 1.5, 3.0


def density(text: Column) -> Column:
    """Sentence ends for each word of a text."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.when(words > 0, F.regexp_count(text, F.lit("[.!?]")) / words).otherwise(F.lit(0.0))


SPAN = 600.0  # seconds of a video that are sorted together
BLOCK = 1024  # segments of a block


def _spans(key: str, *order: str):
    """A segment's stretch of SPAN seconds, and a window over it: no sort holds a whole video."""
    return F.floor(F.col(order[0]) / SPAN), Window.partitionBy(key, "_c").orderBy(*order)


def gaps(segments: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds gap: the time from a segment's end to the next one's start; null after the last.

    ``order`` begins with the start. The last segment of a stretch looks at the
    first of the next, which comes from one summary row for each stretch.
    """
    span, w = _spans(key, *order)
    s = segments.withColumn("_c", span)
    firsts = s.groupBy(key, "_c").agg(F.min("start").alias("_f"))
    ahead = firsts.select(key, "_c", F.lead("_f").over(Window.partitionBy(key).orderBy("_c")).alias("_next"))
    return s.withColumn("_lead", F.lead("start").over(w)).join(ahead, [key, "_c"]).withColumn("gap", F.coalesce("_lead", "_next") - (F.col("start") + F.col("duration"))).drop("_c", "_lead", "_next")


def positions(segments: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds i and n: a segment's place in its video, counted from 0, and how many there are: by counts of stretches."""
    span, w = _spans(key, *order)
    s = segments.withColumn("_c", span)
    video = Window.partitionBy(key)
    counts = s.groupBy(key, "_c").agg(F.count("*").alias("_k")).withColumn("_before", F.coalesce(F.sum("_k").over(video.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("_k").over(video)).drop("_k")
    return s.withColumn("i", F.row_number().over(w) - 1).join(counts, [key, "_c"]).withColumn("i", F.col("i") + F.col("_before")).drop("_c", "_before")


def outlier_gaps(segments: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds outlier: gaps unusual against the median of the ten around them.

    The frame starts five gaps back, at the first gap at the earliest, and holds
    ten gaps from there. Blocks of BLOCK segments come with the few of their
    neighbours that a frame can reach, so a long video is many sorts.
    """
    g = positions(gaps(segments, key, order), key, order)
    block = F.floor(F.col("i") / BLOCK)
    near = F.array_distinct(F.array(block, F.floor((F.col("i") + 5) / BLOCK), F.floor((F.greatest(F.col("i") - GAPS, F.lit(0))) / BLOCK)))
    g = g.withColumn("_b", F.explode(near))
    w = Window.partitionBy(key, "_b").orderBy("i")
    frame = F.when(F.col("i") < 5, F.slice(F.collect_list("gap").over(w.rowsBetween(-5, GAPS)), 1, GAPS)).otherwise(F.collect_list("gap").over(w.rowsBetween(-5, 4)))
    g = g.withColumn("_frame", F.array_sort(frame)).where(F.col("_b") == block)
    k = F.size("_frame")
    middle = F.when(k % 2 == 1, F.get("_frame", F.floor(k / 2).cast("int"))).otherwise((F.get("_frame", (k / 2 - 1).cast("int")) + F.get("_frame", (k / 2).cast("int"))) / 2)
    limit = F.when(F.col("n") - 1 < GAPS, F.lit(FIXED_OUTLIER)).otherwise(F.greatest(TIMES_MEDIAN * middle, F.lit(LEAST_OUTLIER)))
    return g.withColumn("outlier", F.coalesce(F.col("gap") >= limit, F.lit(False))).drop("i", "n", "_b", "_frame")


def _fold(sentence_aware: bool | None, shortest: float, longest: float, pause: float):
    """Windows of sorted segments, one video after another, in constant memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, win = None, 0
        first = end = None
        ends_sentence = False
        for batch in batches:
            out = []
            for key, start, duration, text, aware in zip(*(batch.column(c).to_pylist() for c in range(5))):
                stop = start + duration
                if key != video:
                    video, win, first = key, 0, start
                elif stop - first > longest or end - first >= shortest and (aware and ends_sentence or start - end >= pause):
                    win, first = win + 1, start
                end, ends_sentence = stop, (text or "").rstrip()[-1:] in (".", "!", "?") and bool((text or "").rstrip())
                out.append(win)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.int32())], names=[*batch.schema.names[:4], "win"])

    return run


def windows(segments: DataFrame, key: str, order: list[str], shortest: float = SHORTEST, longest: float = LONGEST, pause: float = PAUSE) -> DataFrame:
    """Adds win: the window of each segment, about half a minute long.

    A window is cut before it would pass the longest, and from the shortest on
    at a sentence end (punctuated manual captions, column ``aware``) or a pause.
    The fold is sequential by definition; it runs over the sorted rows of a
    partition as a stream, so a long video takes time but no memory.
    """
    kind = dict(segments.dtypes)[key]
    return (
        segments.repartition(key).sortWithinPartitions(key, *order)
        .select(key, "start", "duration", "text", "aware")
        .mapInArrow(_fold(None, shortest, longest, pause), f"`{key}` {kind}, start double, duration double, text string, win int")
    )


def chapter_of(wins: DataFrame, chapters: DataFrame, key: str, at: str) -> DataFrame:
    """Adds chapter: the first titled chapter whose half-open interval holds a window's start. A video's
    chapters come as one array, so a window stays one row."""
    c = chapters.where("title IS NOT NULL").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "start_time", "end_time", "title"))).alias("_c"))
    t = F.col(at)
    held = F.filter("_c", lambda x: (x["start_time"] <= t) & (t < x["end_time"]))
    return wins.join(c, key, "left").withColumn("chapter", F.get(held, F.lit(0))["title"]).drop("_c")


def chapter_marks(wins: DataFrame, chapters: DataFrame, key: str, at: str) -> DataFrame:
    """(key, pos, win): each chapter's first window that starts with or after it, by a forward as-of join."""
    w = wins.select(key, F.col(at).alias("t"), F.lit(1).alias("what"), "win", F.lit(None).cast("int").alias("pos"))
    c = chapters.select(key, F.col("start_time").alias("t"), F.lit(0).alias("what"), F.lit(None).cast("int").alias("win"), F.col("pos").cast("int"))
    ahead = Window.partitionBy(key).orderBy("t", "what", "win").rowsBetween(0, Window.unboundedFollowing)
    return w.unionByName(c).withColumn("win", F.first("win", True).over(ahead)).where("what = 0 AND win IS NOT NULL").select(key, "pos", "win")


def flat(segments: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, text): all words of a video with single blanks."""
    parts = segments.where(F.trim("text") != "")
    return parts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.trim("text").alias("_t")))), lambda x: x["_t"]), " ").alias("text"))
