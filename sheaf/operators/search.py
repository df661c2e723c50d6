"""Inverted index and BM25 over documents or over the slices of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.sources.tables import spread

K1, B = 1.2, 0.75
MAX_TERM_BYTES = 40


def terms(text: Column) -> Column:
    """Default analyser: runs of letters and digits in lower case, without terms of 40 bytes or more."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.octet_length(t) < MAX_TERM_BYTES)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, term) of every term; a null text has none."""
    return spread(docs.select(key, text)).select(key, F.posexplode(terms(F.col(text))).alias("pos", "term"))


def field_lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, len) of every row, null texts counting as empty."""
    return docs.select(key, F.coalesce(F.size(terms(F.col(text))), F.lit(0)).cast("long").alias("len"))


def bm25(docs: DataFrame, key: str, text: str, query: list[str], limit: int | None = 50, boosts: dict[str, float] | None = None) -> DataFrame:
    """Score of every row that holds any of the query terms, best first, ties by key.

    Term frequencies are counted inside each row, so only rows with a hit
    travel, with one number for each term; corpus statistics are one global
    aggregate of as many numbers as there are terms.
    """
    fields = boosts or {text: 1.0}
    query = list(dict.fromkeys(q.lower() for q in query))
    out = None
    for field, boost in fields.items():
        one = _field_scores(docs, key, field, query, boost)
        out = one if out is None else out.unionByName(one)
    scored = out.groupBy(key).agg(F.sum("score").alias("score")) if len(fields) > 1 else out
    scored = scored.select(key, F.round("score", 6).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(limit) if limit is not None else scored


def _frequencies(base: DataFrame, key: str, field: str, query: list[str]) -> DataFrame:
    """Length of each text and how often it holds each term."""
    words = base.select(key, F.coalesce(terms(F.col(field)), F.array().cast("array<string>")).alias("w"))
    return words.select(key, F.size("w").cast("double").alias("len"), *[(F.size("w") - F.size(F.array_remove("w", q))).cast("double").alias(f"tf{i}") for i, q in enumerate(query)])


def _field_scores(docs: DataFrame, key: str, field: str, query: list[str], boost: float) -> DataFrame:
    base = spread(docs.select(key, field))
    tf = _frequencies(base, key, field, query)
    stats = tf.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avg"), *[F.sum((F.col(f"tf{i}") > 0).cast("double")).alias(f"df{i}") for i in range(len(query))])
    # only texts that hold a term's letters anywhere are cut into terms again
    near = F.lit(False)
    for q in query:
        near = near | F.contains(F.lower(F.col(field)), F.lit(q))
    hit = F.lit(False)
    score = F.lit(0.0)
    for i in range(len(query)):
        t, d = F.col(f"tf{i}"), F.col(f"df{i}")
        hit = hit | (t > 0)
        idf = F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5))
        score = score + boost * idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return _frequencies(base.where(near), key, field, query).where(hit).join(F.broadcast(stats)).select(key, score.alias("score"))


# fixed values: scripts written without spaces, with their letters and marks
UNSPACED = (
    r"[\x{3041}-\x{309F}\x{30A1}-\x{30FA}\x{30FC}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}\x{20000}-\x{3FFFF}"
    r"\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}\x{AC00}-\x{D7A3}\x{D7B0}-\x{D7FF}\x{0E01}-\x{0E3A}\x{0E40}-\x{0E4E}\x{0E81}-\x{0ECD}\x{0F40}-\x{0FBC}\x{1000}-\x{1049}\x{1050}-\x{109D}\x{1780}-\x{17D3}]+"
)


def unspaced_runs(text: Column) -> Column:
    """Runs of text in scripts without spaces, in order."""
    return F.regexp_extract_all(text, F.lit(UNSPACED), F.lit(0))


def unspaced_match(text: Column, term: str) -> Column:
    """Whether a term stands inside one run; one that punctuation splits does not."""
    return F.exists(unspaced_runs(text), lambda r: F.contains(r, F.lit(term)))


class Query:
    """A parsed query: a condition over the terms of a text, the terms that score, and warnings.

    Grammar: words are alternatives, +word must be there, -word must not, "a b" is a
    phrase, "a b"~n allows n words in between, word~d allows d wrong letters, AND, OR, NOT
    and brackets group. What cannot be read is dropped with a warning.
    """

    def __init__(self, text: str):
        import re

        self.tokens = re.findall(r'[+-]?"[^"]*"(?:~\d+)?|[+-]?\(|\)|[^\s()"]+', text or "")
        self.at, self.warnings, self.terms = 0, [], []
        self.tree = self._any()
        while self.at < len(self.tokens):
            self.warnings.append(f"unexpected {self.tokens[self.at]}")
            self.at += 1
            more = self._any()
            self.tree = ("or", [self.tree, more]) if more else self.tree

    def _any(self):
        should, must, never = [], [], []
        joined = None
        while self.at < len(self.tokens) and self.tokens[self.at] != ")":
            tok = self.tokens[self.at]
            if tok in ("AND", "OR", "NOT"):
                self.at += 1
                if tok == "NOT":
                    node = self._one("")
                    if node:
                        never.append(node)
                else:
                    joined = tok
                continue
            sign = tok[0] if tok[0] in "+-" and len(tok) > 1 else ""
            node = self._one(sign)
            if node is None:
                continue
            if joined == "AND" and should:
                must.append(should.pop())
                must.append(node)
            elif joined == "AND" and must:
                must.append(node)
            else:
                (never if sign == "-" else must if sign == "+" else should).append(node)
            joined = None
        if not (should or must or never):
            return None
        return ("bool", should, must, never)

    def _one(self, sign: str):
        if self.at >= len(self.tokens):
            self.warnings.append("query ends early")
            return None
        tok = self.tokens[self.at][len(sign) :]
        self.at += 1
        if tok == "(":
            node = self._any()
            if self.at < len(self.tokens) and self.tokens[self.at] == ")":
                self.at += 1
            else:
                self.warnings.append("missing )")
            return node
        import re

        if tok.startswith('"'):
            body, _, slop = tok[1:].partition('"')
            words = re.findall(r"[^\W_]+", body.lower())
            if sign != "-":
                self.terms += words
            return ("phrase", words, int(slop[1:] or 0) if slop.startswith("~") else 0) if words else None
        fuzzy = re.fullmatch(r"(.+?)~(\d?)", tok)
        words = re.findall(r"[^\W_]+", (fuzzy[1] if fuzzy else tok).lower())
        if re.search(r"[:^*?\\]", tok):
            self.warnings.append(f"punctuation dropped in {tok}")
        if not words:
            return None
        if sign != "-":
            self.terms += words
        nodes = [("fuzzy", w, int(fuzzy[2] or 1)) if fuzzy else ("term", w) for w in words]
        return nodes[0] if len(nodes) == 1 else ("bool", nodes, [], [])

    def condition(self, words: Column) -> Column:
        """The query as a boolean over an array of terms: no join, one pass."""
        return self._condition(self.tree, words) if self.tree else F.lit(False)

    def _condition(self, node, words: Column) -> Column:
        if node[0] == "term":
            return F.array_contains(words, node[1])
        if node[0] == "fuzzy":
            return F.exists(words, lambda w: F.levenshtein(w, F.lit(node[1])) <= node[2])
        if node[0] == "phrase":
            return _phrase(words, node[1], node[2])
        if node[0] == "or":
            return self._condition(node[1][0], words) | self._condition(node[1][1], words)
        _, should, must, never = node
        out = F.lit(True)
        for m in must:
            out = out & self._condition(m, words)
        for n in never:
            out = out & ~self._condition(n, words)
        if should and not must:
            anyone = F.lit(False)
            for s in should:
                anyone = anyone | self._condition(s, words)
            out = out & anyone
        return out


def _phrase(words: Column, phrase: list[str], slop: int) -> Column:
    if not slop:
        padded = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        return F.contains(padded, F.lit(" " + " ".join(phrase) + " "))
    at = F.filter(F.transform(words, lambda w, i: F.when(w == phrase[0], i)), lambda i: i.isNotNull())
    rest = F.array(*map(F.lit, phrase[1:])) if phrase[1:] else F.array().cast("array<string>")

    def from_here(i):
        # each next word is looked for after the one before, so a place counts once; the nearest keeps the span least
        def step(p, w):
            k = F.array_position(F.slice(words, p + 2, len(phrase) + slop), w).cast("int")
            return F.when((p >= 0) & (k > 0), p + k).otherwise(F.lit(-1))

        last = F.aggregate(rest, i, step)
        return (last >= 0) & (last - i < len(phrase) + slop)

    return F.exists(at, from_here)


def matching(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """Keys of the rows that a query matches."""
    words = F.coalesce(terms(F.col(text)), F.array().cast("array<string>"))
    return spread(docs.select(key, text)).select(key, words.alias("_w")).where(Query(query).condition(F.col("_w"))).select(key)
