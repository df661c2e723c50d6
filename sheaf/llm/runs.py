"""Runs of repeated cues in transcripts (problem 3).

Boundary interval lookup: the cues of one entity chunk (a video and a range of
seg_idx, so that a live stream spreads over many chunks) are gathered into
sorted arrays; the positions at which a cue does not repeat the one before are
the run starts of the chunk. Every cue finds its run by the last start at or
before it, and chunks are joined through a summary row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.session import cut

CHUNK = 256


def spoken(text: Column) -> Column:
    """The words of a cue: lower case, without markup, entities, punctuation and spacing; null if none."""
    low = F.lower(text)  # entities are lowered with the words: captions in capitals write &GT;
    t = low
    for _ in range(2):  # entities may be escaped twice
        for entity, char in (("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            t = F.replace(t, F.lit(entity), F.lit(char))
    # most cues have no entities and no markup
    t = F.when(F.contains(text, F.lit("&")), t).otherwise(low)
    t = F.when(t.rlike("[<{]"), F.regexp_replace(t, r"</?[a-z][^>]*>|\{\\[^}]*\}", " ")).otherwise(t)
    t = F.regexp_replace(t, r"['`\x{2019}\x{00AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]", "")
    t = F.trim(F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}]+", " "))
    return F.when(t != "", t)


def slipped(a: str, b: str) -> bool:
    """Two words that differ by one letter left out, doubled or swapped with its neighbour. A number never slips."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or not (a.isalpha() and b.isalpha()):
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    if len(a) < len(b):
        return a[k:] == b[k + 1 :]
    return a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :]


def same_words(a: str | None, b: str | None) -> bool:
    """Whether two cues say the same words in the same order, but for one slipped letter in a word."""
    if a is None or b is None:
        return False
    if a == b:
        return True
    aw, bw = a.split(" "), b.split(" ")
    return len(aw) == len(bw) and all(x == y or slipped(x, y) for x, y in zip(aw, bw))


def _intervals(least: int):
    """Chunks of cues to intervals of repeated cues. The run starts of a chunk are a
    sorted array; each cue finds its interval in it by binary search. Intervals of
    fewer cues than ``least`` come out only at a chunk's edges, where they may go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rows, picked = batch.num_columns - 1, [], []
            for r, q in enumerate(batch.column(n).to_pylist()):
                q = [x for k, x in enumerate(q) if k == 0 or x["i"] != q[k - 1]["i"]]
                starts = np.array([k for k, x in enumerate(q) if k == 0 or not same_words(q[k - 1]["w"], x["w"])])
                place = np.searchsorted(starts, np.arange(len(q)), side="right") - 1
                count = np.bincount(place)
                last = np.append(starts[1:], len(q)) - 1
                for j, (a, b) in enumerate(zip(starts.tolist(), last.tolist())):
                    edge = j in (0, len(starts) - 1)
                    if not edge and (count[j] < least or q[a]["w"] is None):
                        continue
                    m = q[a : b + 1]
                    s = [x["s"] for x in m if x["s"] is not None]
                    e = [x["e"] for x in m if x["e"] is not None]
                    rows.append((j, edge, q[a]["i"], q[b]["i"], int(count[j]), min(s, default=None), max(e, default=None), q[a]["w"], q[b]["w"]))
                    picked.append(r)
            keys = batch.select(range(n)).take(pa.array(picked, pa.int32()))
            values = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(_OUT), _OUT.values())]
            yield pa.RecordBatch.from_arrays([*keys.columns, *values], names=[*keys.schema.names, *_OUT])

    return run


_OUT = {"j": pa.int32(), "edge": pa.bool_(), "first_idx": pa.int64(), "last_idx": pa.int64(), "n": pa.int64(), "s": pa.float64(), "e": pa.float64(), "words": pa.string(), "words_last": pa.string()}
_OUT_DDL = "j int, edge boolean, first_idx long, last_idx long, n long, s double, e double, words string, words_last string"


def _same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_words(x, y) for x, y in zip(a, b)], dtype=bool)


def cue_runs(cues: DataFrame, keys: list[str], order: str, chunk: int = CHUNK, least: int = 1) -> DataFrame:
    """Collapse each run of repeated cues into one row: first and last position, count, whole duration.

    The whole duration runs from the start of the first cue to the latest end,
    null and negative durations counting as 0; it is null without any start.
    Cues need columns ``start``, ``duration`` and ``text``. A null or blank cue
    is in no run and ends one; it gives no row. Rows re-delivered under one key
    count once. Only runs of ``least`` cues or more come out, by default all.
    """
    kinds = dict(cues.dtypes)
    base = cues.where(F.col(order).isNotNull()).select(
        *keys,
        F.expr(f"`{order}` div {chunk}").cast("long").alias("_c"),
        F.struct(
            F.col(order).cast("long").alias("i"),
            F.col("start").alias("s"),
            (F.col("start") + F.greatest(F.coalesce(F.when(~F.isnan("duration"), F.col("duration")), F.lit(0.0)), F.lit(0.0))).alias("e"),
            spoken(F.col("text")).alias("w"),
        ).alias("q"),
    )
    chunks = base.groupBy(*keys, "_c").agg(F.sort_array(F.collect_set("q")).alias("q"))
    # both branches below read the intervals: they are made once
    each = cut(chunks.mapInArrow(_intervals(least), ", ".join([*(f"{k} {kinds[k]}" for k in keys), "_c long", _OUT_DDL])))
    # a run may go on over chunk borders: the first and the last interval of each chunk (two
    # rows for CHUNK cues) are all that is sorted for a whole video
    inner = each.where("NOT edge AND words IS NOT NULL").select(*keys, "first_idx", "last_idx", "n", "s", "e", "words")
    walk = Window.partitionBy(*keys).orderBy("_c", "j")
    stitched = (
        each.where("edge")
        .withColumn("before", F.when(F.col("j") == 0, F.lag("words_last").over(walk)))
        .withColumn("goes_on", F.when(F.col("before").isNotNull() & F.col("words").isNotNull(), F.pandas_udf(_same, "boolean")("before", "words")).otherwise(F.lit(False)))
        .withColumn("run", F.sum((~F.col("goes_on")).cast("long")).over(walk))
        .groupBy(*keys, "run")
        .agg(F.min("first_idx").alias("first_idx"), F.max("last_idx").alias("last_idx"), F.sum("n").alias("n"), F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("words", "first_idx").alias("words"))
        .where((F.col("words").isNotNull()) & (F.col("n") >= least))
        .drop("run")
    )
    return inner.unionByName(stitched).select(*keys, "first_idx", "last_idx", F.col("n").cast("int").alias("cues"), F.col("s").alias("start"), (F.col("e") - F.col("s")).alias("duration"), "words")


def found(captions: DataFrame) -> DataFrame:
    """The longest runs of two or more cues."""
    return cue_runs(captions.where("video_id IS NOT NULL"), ["video_id"], "seg_idx", least=2).select("video_id", F.col("first_idx").cast("int").alias("first_idx"), F.col("last_idx").cast("int").alias("last_idx"))


IN_WINDOW = 1 << 32  # positions kept apart for the segments of one window: more than an array can hold


def window_runs(windows: DataFrame, least: int = 1) -> DataFrame:
    """Runs among the segments inside Window rows; a run may go on from one window into the next.

    Comes with the window and the place in it of the first and the last cue.
    """
    flat = windows.where("video_id IS NOT NULL AND win_idx IS NOT NULL").select("video_id", "win_idx", F.posexplode("segments").alias("p", "g"))
    flat = flat.select("video_id", (F.col("win_idx").cast("long") * IN_WINDOW + F.col("p")).alias("at"), "g.start", "g.duration", "g.text")
    r = cue_runs(flat, ["video_id"], "at", chunk=8 * IN_WINDOW, least=least)
    place = [F.expr(f"cast({c} div {IN_WINDOW} AS int)").alias(f"{n}_win") for n, c in (("first", "first_idx"), ("last", "last_idx"))] + [F.expr(f"cast({c} % {IN_WINDOW} AS int)").alias(f"{n}_pos") for n, c in (("first", "first_idx"), ("last", "last_idx"))]
    return r.select("video_id", *place, "cues", "start", "duration", "words")
