"""Encoding of texts with a public byte-level BPE vocabulary (problem 8).

Prefix-sharing trie traversal. A text is cut into words by the vocabulary's
pattern; the distinct words of a batch go into a byte trie. The traversal is
depth-first and carries for each node the last token of the encoding of its
path: of all tokens that end there, the one that stays itself next to the last
token of the path before it. A shared prefix is therefore encoded once. A
word's ids are read backwards along its path. Words stay in the worker's memory
between batches, up to KEEP of them, and twice as many facts of token pairs;
nothing is shuffled or broadcast.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.sources.tables import spread

DEFAULT_VOCABULARY = "byte_bpe_50k"
KEEP = 400_000
FOLDER = "/opt/tokenizers"

# white space as the vocabulary's own pattern has it
_SPACE = r"\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_ASCII = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


@lru_cache(1)
def _unicode_pattern():
    import regex

    return regex.compile(rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def words(text: str) -> list[str]:
    """The words the vocabulary is applied to; joined they are the text."""
    return _ASCII.findall(text) if text.isascii() else _unicode_pattern().findall(text)


class TrieEncoder:
    """Encodes distinct words over one trie."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        # the longest token that ends with two given bytes: most of a long word's ends have short ones only
        self.longest: dict[bytes, int] = {}
        for t in ranks:
            if len(t) > 1:
                self.longest[t[-2:]] = max(len(t), self.longest.get(t[-2:], 1))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.sure: set[int] = set()  # tokens known to stand
        self.bytes_of = {v: k for k, v in ranks.items()}

    def forget(self) -> None:
        """What is known of tokens side by side goes; it is found again where it is needed."""
        self.pairs.clear()
        self.sure.clear()

    def merge(self, text: bytes) -> list[int]:
        """Plain byte pair encoding of a short string; decides which tokens may stand side by side."""
        parts, ranks = [text[i : i + 1] for i in range(len(text))], self.ranks
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [ranks[p] for p in parts]

    def beside(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when their bytes are encoded together."""
        key = (a, b)
        ok = self.pairs.get(key)
        if ok is None:
            ok = self.pairs[key] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return ok

    def encode_all(self, distinct: list[bytes]) -> list[list[int]]:
        """Ids of each word. The words must be sorted, which makes going through
        them the depth-first traversal of their trie: what is kept of the path
        is the part that the next word shares."""
        ranks, longest, beside, stands = self.ranks, self.longest, self.beside, self.sure.__contains__
        last: list[int] = []  # last[i]: last token of the encoding of path[: i + 1]
        size: list[int] = []  # its length in bytes
        path, out = b"", []
        for word in distinct:
            k, least = 0, min(len(path), len(word))
            while k < least and path[k] == word[k]:
                k += 1
            del last[k:], size[k:]
            for i in range(k + 1, len(word) + 1):
                for j in range(max(0, i - longest.get(word[max(0, i - 2) : i], 1)), i):
                    token = ranks.get(word[j:i])
                    if token is not None and (stands(token) or self.stands(word[j:i], token)) and (j == 0 or beside(last[j - 1], token)):
                        last.append(token)
                        size.append(i - j)
                        break
                else:
                    raise ValueError("the vocabulary lacks a single byte")
            path = word
            ids, i = [], len(word)
            while i:
                ids.append(last[i - 1])
                i -= size[i - 1]
            out.append(ids[::-1])
        return out

    def stands(self, text: bytes, token: int) -> bool:
        """Whether a token's own bytes encode to it (not every rank is reachable)."""
        key = (token, -1)
        ok = self.pairs.get(key)
        if ok is None:
            ok = self.pairs[key] = self.merge(text) == [token]
            if ok:
                self.sure.add(token)
        return ok


@lru_cache(4)
def encoder(vocabulary: str, folder: str) -> TrieEncoder:
    with open(f"{folder}/{vocabulary}.tiktoken", "rb") as f:
        return TrieEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class _Known:
    """Words already encoded: their ids stand one after the other in one array, which doubles when it is full."""

    def __init__(self, trie: TrieEncoder):
        self.trie, self.number, self.used = trie, {}, 0
        self.ids, self.start, self.length = np.empty(1 << 12, np.int32), np.empty(1 << 10, np.int64), np.empty(1 << 10, np.int64)

    def learn(self, seen: set[str]) -> None:
        new = sorted((w.encode("utf-8", "surrogatepass"), w) for w in seen.difference(self.number))
        if not new:
            return
        encoded = self.trie.encode_all([b for b, _ in new])
        length = np.fromiter(map(len, encoded), np.int64, len(encoded))
        first, total = len(self.number), int(length.sum())
        self.ids = _room(self.ids, self.used + total)
        self.start, self.length = _room(self.start, first + len(new)), _room(self.length, first + len(new))
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(encoded), np.int32, total)
        self.start[first : first + len(new)] = self.used + np.cumsum(length) - length
        self.length[first : first + len(new)] = length
        self.used += total
        self.number.update((w, first + k) for k, (_, w) in enumerate(new))

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts and the ids of all."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(texts)), np.int64, int(size.sum()))
        length = self.length[at]
        ends = np.cumsum(length)
        place = np.repeat(self.start[at] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)
        return np.append(0, ends)[np.append(0, np.cumsum(size))], self.ids[place]


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    out = np.empty(max(size, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


@lru_cache(1)
def _known(vocabulary: str, folder: str) -> _Known:
    """A worker's words; its later tasks find them as well."""
    return _Known(encoder(vocabulary, folder))


def _encode(vocabulary: str, folder: str, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(vocabulary, folder)
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                texts = [words(t) if t else [] for t in batch.column(1).to_pylist()]
                if len(known.number) > keep or len(known.trie.pairs) > 2 * keep:
                    known.trie.forget()
                    _known.cache_clear()
                    known = _known(vocabulary, folder)
                known.learn(set(chain.from_iterable(texts)))
                offsets, flat = known.encode(texts)
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return run


def encode(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, folder: str = FOLDER, keep: int = KEEP) -> DataFrame:
    """doc_id and ids of every row. A null or empty text gives an empty list;
    what looks like a special token is ordinary text. ``folder`` is where the
    vocabulary files are, on every executor."""
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    return spread(rows).mapInArrow(_encode(vocabulary, folder, keep), "doc_id long, ids array<int>")
