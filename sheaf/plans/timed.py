"""Timed segments over captions and chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.text import clock
from sheaf.operators import timed as tm
from sheaf.operators.search import terms
from sheaf.sources.tables import table

ORDER = ["start", "seg_idx"]


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Cues once each, with words and times; null durations count as 0."""
    c = table(spark, d, "captions").where("video_id IS NOT NULL AND seg_idx IS NOT NULL AND start IS NOT NULL AND trim(text) <> ''")
    once = c.groupBy("video_id", "seg_idx").agg(F.min("start").alias("start"), F.coalesce(F.min(F.nanvl("duration", F.lit(None).cast("double"))), F.lit(0.0)).alias("duration"), F.min("text").alias("text"), F.min("is_generated").alias("is_generated"))
    return once.withColumn("text", F.regexp_replace(F.trim("text"), r"\s+", " "))


_SEG = "(SELECT video_id, seg_idx, min(start) AS start, coalesce(min(CASE WHEN isnan(duration) THEN NULL ELSE duration END), 0.0) AS duration, regexp_replace(trim(min(text)), '\\s+', ' ', 'g') AS text, min(is_generated) AS is_generated FROM captions WHERE start IS NOT NULL AND trim(text) <> '' GROUP BY video_id, seg_idx)"


def _aware(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d)
    per = s.groupBy("video_id").agg((F.sum(F.regexp_count("text", F.lit("[.!?]"))) / F.sum(F.size(F.split("text", " ")))).alias("dens"), F.max("is_generated").alias("auto"))
    return s.join(per, "video_id").withColumn("aware", ~F.col("auto") & (F.col("dens") >= tm.DENSITY))


def w1_gaps(spark: SparkSession, d: str) -> DataFrame:
    return tm.gaps(_segments(spark, d), "video_id", ORDER).select("video_id", "seg_idx", (F.round("gap", 6) + 0.0).alias("gap"))


def w2_outlier_gaps(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d).select("video_id", "seg_idx", F.round("start", 2).alias("start"), F.round("duration", 2).alias("duration"))
    s = s.withColumn("start", F.round(F.col("start") * 100).cast("double")).withColumn("duration", F.round(F.col("duration") * 100).cast("double"))
    return tm.outlier_gaps(s.withColumn("start", F.col("start") / 64).withColumn("duration", F.col("duration") / 64), "video_id", ORDER).select("video_id", "seg_idx", "outlier")


def w4_gate(spark: SparkSession, d: str) -> DataFrame:
    return _aware(spark, d).select("video_id", "aware", F.round("dens", 6).alias("dens")).distinct()


def _windows(spark: SparkSession, d: str) -> DataFrame:
    # whole 64ths of a second, so that sums are exact in every order
    a = _aware(spark, d)
    for c in ("start", "duration"):
        a = a.withColumn(c, F.round(F.col(c) * 64) / 64)
    return tm.windows(a, "video_id", ORDER)


def w3_windows(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).groupBy("video_id", "win").agg(F.min("start").alias("start"), F.count("*").alias("n"))


def _chapters(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    c = table(spark, d, "chapters").where("video_id IS NOT NULL AND start_time IS NOT NULL AND end_time IS NOT NULL").distinct()
    return c.withColumn("pos", F.row_number().over(Window.partitionBy("video_id").orderBy("start_time", "end_time", "title")))


def j6_chapter_of(spark: SparkSession, d: str) -> DataFrame:
    return tm.chapter_of(w3_windows(spark, d), _chapters(spark, d), "video_id", "start").select("video_id", "win", "chapter")


def j7_chapter_marks(spark: SparkSession, d: str) -> DataFrame:
    return tm.chapter_marks(w3_windows(spark, d), _chapters(spark, d), "video_id", "start")


def f39_absolute(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).select("video_id", "seg_idx", F.concat(F.lit("["), clock(F.col("start")), F.lit("] "), "text").alias("line"))


def f39_flat(spark: SparkSession, d: str) -> DataFrame:
    return tm.flat(_segments(spark, d), "video_id", ["start", "seg_idx"])


def a14_density(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.round(tm.density(F.col("text")), 6).alias("density"))


def q7_time_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Windows that overlap 60 to 120 seconds and hold a word, in time order: the first 50."""
    w = _windows(spark, d).groupBy("video_id", "win").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("duration")).alias("stop"), F.max(F.array_contains(terms(F.col("text")), "checkpoint").cast("int")).alias("hit"))
    return w.where("start < 120 AND stop > 60 AND hit = 1").orderBy("start", "video_id", "win").limit(50).select("video_id", "win", "start")


def q8_context(spark: SparkSession, d: str) -> DataFrame:
    """The hits of q7 without time bounds, with the windows before and after."""
    w = _windows(spark, d).groupBy("video_id", "win").agg(F.max(F.array_contains(terms(F.col("text")), "checkpoint").cast("int")).alias("hit"))
    near = w.where("hit = 1").select("video_id", F.explode(F.sequence(F.col("win") - 1, F.col("win") + 1)).alias("win")).distinct()
    return near.join(w.select("video_id", "win"), ["video_id", "win"])


def t2_first_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).orderBy("start", "video_id", "seg_idx").limit(50).select("video_id", "seg_idx", "start")


def a19_median(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"))


QUERIES = {f.__name__: f for f in (w1_gaps, w2_outlier_gaps, w3_windows, w4_gate, j6_chapter_of, j7_chapter_marks, f39_absolute, f39_flat, a14_density, q7_time_overlap, q8_context, t2_first_segments, a19_median)}

_AWARE = f"seg AS {_SEG}, per AS (SELECT video_id, sum(length(text) - length(regexp_replace(text, '[.!?]', '', 'g'))) / sum(len(string_split(text, ' '))) AS dens, bool_or(is_generated) AS auto FROM seg GROUP BY video_id), aw AS (SELECT s.video_id, s.seg_idx, round(s.start * 64) / 64 AS start, round(s.duration * 64) / 64 AS duration, s.text, NOT auto AND dens >= 0.05 AS aware, dens FROM seg s JOIN per USING (video_id))"
_WIN = f"""WITH RECURSIVE {_AWARE}, o AS (SELECT *, start + duration AS stop, row_number() OVER (PARTITION BY video_id ORDER BY start, seg_idx) AS k, regexp_matches(text, '[.!?]$') AS fin FROM aw),
f AS (SELECT video_id, k, seg_idx, start, stop, text, 0 AS win, start AS first, fin, aware FROM o WHERE k = 1
 UNION ALL SELECT o.video_id, o.k, o.seg_idx, o.start, o.stop, o.text,
  CASE WHEN o.stop - f.first > 35 OR (f.stop - f.first >= 25 AND ((f.aware AND f.fin) OR o.start - f.stop >= 1)) THEN f.win + 1 ELSE f.win END,
  CASE WHEN o.stop - f.first > 35 OR (f.stop - f.first >= 25 AND ((f.aware AND f.fin) OR o.start - f.stop >= 1)) THEN o.start ELSE f.first END, o.fin, o.aware
 FROM f JOIN o ON o.video_id = f.video_id AND o.k = f.k + 1),
w AS (SELECT video_id, win, min(start) AS start, max(stop) AS stop, count(*) AS n, bool_or(list_contains(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), 'checkpoint')) AS hit FROM f GROUP BY video_id, win)"""
_CHAP = "c AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_time, end_time, title NULLS FIRST) AS pos FROM (SELECT DISTINCT * FROM chapters WHERE start_time IS NOT NULL AND end_time IS NOT NULL))"
_MMSS = "CASE WHEN CAST(floor(start) AS BIGINT) // 3600 > 0 THEN lpad(CAST(CAST(floor(start) AS BIGINT) // 3600 AS VARCHAR), 2, '0') || ':' ELSE '' END || lpad(CAST((CAST(floor(start) AS BIGINT) % 3600) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(start) AS BIGINT) % 60 AS VARCHAR), 2, '0')"
SQL = {
    "w1_gaps": f"SELECT video_id, seg_idx, round(lead(start) OVER (PARTITION BY video_id ORDER BY start, seg_idx) - (start + duration), 6) + 0.0 AS gap FROM {_SEG}",
    "w2_outlier_gaps": f"""WITH s AS (SELECT video_id, seg_idx, CAST(round(start, 2) * 100 AS BIGINT) / 64.0 AS start, CAST(round(duration, 2) * 100 AS BIGINT) / 64.0 AS duration FROM {_SEG}),
g AS (SELECT *, lead(start) OVER w - (start + duration) AS gap, row_number() OVER w - 1 AS i FROM s WINDOW w AS (PARTITION BY video_id ORDER BY start, seg_idx)),
l AS (SELECT video_id, list(gap ORDER BY i) FILTER (gap IS NOT NULL) AS gs FROM g GROUP BY video_id)
SELECT g.video_id, seg_idx, coalesce(gap >= CASE WHEN len(gs) < 10 THEN 3.0 ELSE greatest(2 * list_median(gs[greatest(i - 5, 0) + 1 : least(greatest(i - 5, 0) + 10, len(gs))]), 1.5) END, false) AS outlier FROM g JOIN l USING (video_id)""",
    "w4_gate": f"WITH {_AWARE} SELECT DISTINCT video_id, aware, round(dens, 6) AS dens FROM aw",
    "w3_windows": f"{_WIN} SELECT video_id, win, start, n FROM w",
    "j6_chapter_of": f"{_WIN}, {_CHAP} SELECT w.video_id, w.win, (SELECT arg_min(title, pos) FROM c WHERE c.video_id = w.video_id AND c.start_time <= w.start AND w.start < c.end_time AND title IS NOT NULL) AS chapter FROM w",
    "j7_chapter_marks": f"{_WIN}, {_CHAP} SELECT c.video_id, pos, min(w.win) AS win FROM c JOIN w ON w.video_id = c.video_id AND w.start >= c.start_time GROUP BY c.video_id, pos",
    "f39_absolute": f"SELECT video_id, seg_idx, '[' || {_MMSS} || '] ' || text AS line FROM {_SEG}",
    "f39_flat": f"SELECT video_id, string_agg(text, ' ' ORDER BY start, seg_idx) AS text FROM {_SEG} GROUP BY video_id",
    "a14_density": "SELECT doc_id, round(CASE WHEN n > 0 THEN (length(text) - length(regexp_replace(text, '[.!?]', '', 'g'))) / n ELSE 0 END, 6) AS density FROM (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents WHERE text IS NOT NULL)",
    "q7_time_overlap": f"{_WIN} SELECT video_id, win, start FROM w WHERE start < 120 AND stop > 60 AND hit ORDER BY start, video_id, win LIMIT 50",
    "q8_context": f"{_WIN} SELECT DISTINCT w.video_id, w.win FROM w JOIN w h ON h.video_id = w.video_id AND h.hit AND abs(h.win - w.win) <= 1",
    "t2_first_segments": f"SELECT video_id, seg_idx, start FROM {_SEG} ORDER BY start, video_id, seg_idx LIMIT 50",
    "a19_median": "SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY event_type",
}
