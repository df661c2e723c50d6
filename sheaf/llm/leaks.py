"""Evaluation passages in training text (problem 9).

Distributed positional inverted index: the postings of the corpus, (term,
document, positions), are written once as a table for all terms of the test
passages. A term is a run of RUN words, as single words are seldom rare. A passage is looked up by its rarest terms: each window of WINDOW words keeps the
rarest one and the rarest that shares no word with it, so that one replaced word
leaves one of them whole. Joined with the postings and moved by the term's offset
in the passage, their positions meet at the place where the passage would begin;
only such places are compared word for word. Rarity is counted over all
documents. Passages, like documents, are rows of a table throughout; what every
worker gets is a bitmap of fixed size that tells terms no passage has.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import checkpoint_dir, cut
from sheaf.sources.tables import maybe_broadcast, spread

WINDOW = 14
REPLACED = 1  # the choice of terms rests on this
RUN = 4  # words of a term; two that share no word fit into a window wherever one of them stands
SHARD = 500  # documents whose terms are looked at together
BITS = 25  # the bitmap has 2 ** BITS bits, 4 MB, whatever the number of terms; fuller, it lets more through and loses nothing
KEEP = 500_000  # words whose codes a worker remembers

_WORD = re.compile(r"[^\W_]+")
_IN_NUMBER = re.compile(r"(\d)[.,](?=\d)")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_LINK = re.compile(r"\]\([^()\s]*\)")
_NOTHING = dict.fromkeys([0xAD, *range(0x200B, 0x200E), 0x2060, 0xFEFF, 0x27, 0x2019, 0x60])


def words_of(text: str | None) -> list[str]:
    """Words without case, punctuation, markup, spacing and invisible characters."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_NOTHING)
    elif "'" in text or "`" in text:
        text = text.replace("'", "").replace("`", "")
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "](" in text:
        text = _LINK.sub("]", text)
    return _WORD.findall(_IN_NUMBER.sub(r"\1", text.lower()))


class _Codes:
    """64-bit codes of words; equal words always have equal codes, and what meets by chance is compared word for word."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > KEEP:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def terms(codes: np.ndarray) -> np.ndarray:
    """The code of each run of RUN words."""
    n = len(codes) - RUN + 1
    if n < 1:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        mixed = codes[:n]
        for k in range(1, RUN):
            mixed = ((mixed ^ (mixed >> np.uint64(31))) * _FACTOR) ^ codes[k : k + n]
        return (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


_TERMS = pa.schema([("pid", pa.int64()), ("off", pa.int32()), ("term", pa.int64())])


def _passage_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = _Codes()
    for batch in batches:
        found = [terms(codes.of(w)) for w in batch.column(1).to_pylist()]
        size = [len(t) for t in found]
        off = np.concatenate([np.arange(n, dtype=np.int32) for n in size]) if size else np.empty(0, np.int32)
        flat = np.concatenate(found).view(np.int64) if size else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), size)), pa.array(off), pa.array(flat)], schema=_TERMS)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words_of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["item_id", "words"])


_POSTINGS = pa.schema([("term", pa.int64()), ("doc_id", pa.int64()), ("positions", pa.list_(pa.int32()))])


def _postings(shared):
    """Documents to the postings of terms that may be in a passage: one row for each term of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, codes, shift = np.frombuffer(shared.value, dtype=np.uint8), _Codes(), np.uint64(64 - BITS)
        for whole in batches:
            for k in range(0, whole.num_rows, SHARD):
                batch = whole.slice(k, SHARD)
                texts = [words_of(t) for t in batch.column(1).to_pylist()]
                size = np.array([len(w) for w in texts], dtype=np.int64)
                term = terms(codes.of([w for t in texts for w in t]))
                place = term >> shift
                may = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
                ends = np.cumsum(size)
                for k in range(1, RUN):  # no term reaches into the next text
                    reach = ends - k
                    may[reach[(reach >= 0) & (reach < len(may))]] = 0
                at = np.flatnonzero(may)
                doc = np.searchsorted(ends, at, side="right")
                order = np.lexsort((at, term[at], doc))
                at, doc, t = at[order], doc[order], term[at][order]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (t[1:] != t[:-1])
                first = np.flatnonzero(new)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(at - (ends - size)[doc], pa.int32()))
                ids = batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(t[first].view(np.int64)), pa.array(ids[doc[first]]), lists], schema=_POSTINGS)

    return run


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms, with their offsets, that each passage is looked up by."""
    for batch in batches:
        rows = []
        for pid, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rarity = [x["n"] for x in found]
            chosen = set()
            for a in range(len(found) - WINDOW + RUN):
                window = sorted(range(a, a + WINDOW - RUN + 1), key=lambda i: (rarity[i], i))
                chosen |= {window[0], next(i for i in window if abs(i - window[0]) >= RUN)}
            rows += [(pid, i, found[i]["term"]) for i in sorted(chosen) if rarity[i]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 3, _TERMS)], schema=_TERMS)


def _compare(words: np.ndarray, passage: np.ndarray, begins: np.ndarray) -> tuple[int, int]:
    """(longest stretch in words, words equal) of a passage laid on a text at places, one word in WINDOW replaced; 0, 0 if nowhere."""
    place = begins[:, None] + np.arange(len(passage))
    inside = (place >= 0) & (place < len(words))
    equal = (words[np.clip(place, 0, len(words) - 1)] == passage) & inside
    view = np.lib.stride_tricks.sliding_window_view
    enough = (view(equal, WINDOW, axis=1).sum(2) >= WINDOW - REPLACED) & view(inside, WINDOW, axis=1).all(2)
    best = (0, 0)
    for i in np.flatnonzero(enough.any(1)):
        where = np.flatnonzero(enough[i])
        runs = np.split(where, np.flatnonzero(np.diff(where) > 1) + 1)
        best = max(best, (max(len(r) for r in runs) + WINDOW - 1, int(equal[i].sum())))
    return best


_FOUND = pa.schema([("doc_id", pa.int64()), ("pid", pa.int64()), ("matched_words", pa.int32()), ("equal_words", pa.int32())])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places to matches; as they come from a join by document, those of one stand together and its words are read once."""
    last, words = None, []
    for batch in batches:
        rows = []
        for doc_id, text, pid, passage, begins in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (doc_id, text) != last:
                last, words = (doc_id, text), words_of(text)
            number = {w: k for k, w in enumerate(dict.fromkeys(passage))}
            run, equal = _compare(np.array([number.get(w, -1) for w in words]), np.array([number[w] for w in passage]), np.array(sorted(set(begins))))
            if run:
                rows.append((doc_id, pid, run, equal))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 4, _FOUND)], schema=_FOUND)


def _bitmap(term: DataFrame) -> bytearray:
    """The bitmap of the terms' leading bits: at most 2 ** (BITS - 6) numbers of 64 bits reach the driver."""
    place = F.shiftrightunsigned("term", 64 - BITS)
    parts = term.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(term, {64 - BITS}) & 63 AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (BITS - 6), dtype=np.int64)
    rows = parts.toArrow()
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return bytearray(out.tobytes())


def leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """doc_id, item_id and the length of the longest matching stretch of each leak.

    Null texts, null passages and passages of under WINDOW words match nothing; a
    passage that stands in several items is looked up once and counts for each.
    A document id that stands in several rows leaks what any of them holds.
    """
    spark = documents.sparkSession
    docs = spread(documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    read = eval_items.where("passage IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "passage").distinct()
    items = cut(read.mapInArrow(_words, "item_id long, words array<string>").where(F.size("words") >= WINDOW))
    passages = cut(items.groupBy("words").agg(F.min("item_id").alias("pid")))
    # an item's passage may be had in several forms: the words tell them apart
    members = items.join(passages.withColumnRenamed("pid", "least"), "words").select(F.xxhash64("words").alias("pid"), "item_id").distinct()
    passages = passages.select(F.xxhash64("words").alias("pid"), "words")
    of = cut(passages.mapInArrow(_passage_terms, "pid long, off int, term long"))

    shared = spark.sparkContext.broadcast(bytes(_bitmap(of)))
    where = f"{checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}"
    docs.mapInArrow(_postings(shared), "term long, doc_id long, positions array<int>").write.parquet(where)
    postings = spark.read.schema("term long, doc_id long, positions array<int>").parquet(where)

    counts = postings.groupBy("term").agg(F.sum(F.size("positions")).alias("n"))
    rare = of.join(counts, "term", "left").groupBy("pid").agg(F.transform(F.sort_array(F.collect_list(F.struct("off", "term", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: F.struct(x["term"].alias("term"), x["n"].alias("n"))).alias("t"))
    anchors = cut(rare.mapInArrow(_anchors, "pid long, off int, term long"))
    places = postings.join(anchors, "term").select("doc_id", "pid", F.transform("positions", lambda p: p - F.col("off")).alias("begins"))
    pairs = places.groupBy("doc_id", "pid").agg(F.array_distinct(F.flatten(F.collect_list("begins"))).alias("begins"))
    # places are few beside the texts: written, their size is known, and while it is small the texts stay where they are
    pairs.join(passages, "pid").write.parquet(f"{where}-places")
    asked = docs.join(maybe_broadcast(spark.read.schema("pid long, doc_id long, begins array<int>, words array<string>").parquet(f"{where}-places"), limit=2 << 20), "doc_id").select("doc_id", "text", "pid", "words", "begins")
    hits = asked.mapInArrow(_verify, "doc_id long, pid long, matched_words int, equal_words int")
    best = hits.groupBy("doc_id", "pid").agg(F.max(F.struct("matched_words", "equal_words")).alias("m"))
    return best.join(members, "pid").groupBy("doc_id", "item_id").agg(F.max("m").alias("m")).select("doc_id", "item_id", "m.matched_words", "m.equal_words")


def found(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    return leaks(documents, eval_items).select("doc_id", "item_id")
