"""Texts cut off by a field limit or a broken transfer (problem 10), in SQL.

Word trigrams are counted inside texts and at their ends; a text is cut if its
final trigram is frequent inside and almost never last. Words are first reduced
to classes, so that every trigram has enough occurrences to be judged: in
written text a word is told by letters (w), a number (n) or a capital (X) and
the mark it ends with, and in scripts without spaces a letter is a word; in
running speech without punctuation (captions) the words above SPOKEN_SHARE of
all words stay themselves, and a last word that only begins such words stands
for them. Two marks begin each line of prose, so that short last lines have
trigrams too. A trigram belongs to the kind of line it stands in, as lists, tables and
headings end in other ways than prose: they end without a stop, so there the
ends of all their lines are counted. A text's final trigram is taken without
the dots or the replacement character that a cut may have left.

What follows the trigrams: a last line of a shape with which many texts end (a
signature, a note) is whole. Where trigrams of classes can't tell, three other
signs can: in lists, tables and headings the last word itself, frequent inside
such lines and almost never last, or found nowhere but at ends and the beginning
of a known word; a code fence left open; and in speech, where a sentence may end
after any word, a length far more frequent than its neighbours within a source,
which is a field limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sheaf.session import cut
from sheaf.sources.tables import spread

SPOKEN_SHARE = 0.0015
TERMINAL = 0.02  # "almost never": at most this share of a trigram's occurrences in a kind of line ends a text
SPOKEN_TERMINAL = 0.001  # the same in running speech, where every sentence may end a text
KNOWN = 0.00003  # share of all words from which a word is known
FOOTER = 0.002  # share of all texts from which a last line's shape is a way to end
LIMIT_SHARE = 0.01  # a field limit has so large a share of the source's texts
LIMIT = 10  # and so many times as many as its neighbours

# running speech: at most one mark or capital in 600 characters of the whole text
_SPOKEN = r"regexp_count(text, '[.,;:?!。、#|()\\p{Lu}]|\n\n') * 600 <= length(text)"
_KIND = r"""CASE WHEN line RLIKE '^\\s*[|]' THEN 'table' WHEN line RLIKE '^#' THEN 'heading' WHEN line RLIKE '^([-*+•]|[0-9]+[.)]) ' THEN 'list' ELSE 'prose' END"""
_BLANK = r"' \t\n\r\u000B\u000C\u0085\u00A0\u200B\u2028\u2029\u3000\uFEFF'"

# words of a line as classes; letters of scripts without spaces stand alone
_CLASSES = r"""split(concat(IF(kind = 'prose', '^ ^ ', ''), regexp_replace(regexp_replace(regexp_replace(
  IF(line RLIKE '[\\x{{3040}}-\\x{{9FFF}}\\x{{AC00}}-\\x{{D7A3}}]', regexp_replace(line, '([\\x{{3040}}-\\x{{9FFF}}\\x{{AC00}}-\\x{{D7A3}}][^\\p{{L}}\\p{{N}}\\s]*)(?=.)', '$1 '), line),
  '[\\p{{Ll}}\\p{{Lo}}\\p{{M}}]+', 'w'), '\\p{{Lu}}+w?', 'X'), '\\p{{N}}+', 'n')), ' +')"""
# a trigram of classes in short: what each word is made of and the mark it ends with
_SHORT = r"""array_join(transform(split(g, ' '), y -> concat(
  CASE WHEN contains(y, 'n') THEN 'n' WHEN contains(y, 'X') THEN 'X' WHEN contains(y, 'w') THEN 'w' WHEN y = '^' THEN '^' ELSE '_' END, regexp_extract(y, '([.,;:?!、。])[^wXn]*$', 1))), ' ')"""

_FEATURES = r"""
SELECT doc_id, source, n, spoken, fence, open_end, kind, {short} AS g, shape,
  CASE WHEN kind IN ('table', 'heading', 'list') THEN regexp_extract(lower(line), '([\\p{{L}}\\p{{M}}\\p{{N}}]+)$', 1) ELSE '' END AS word
FROM (
  SELECT *, array_join(slice(words, -least(3, size(words)), 3), ' ') AS g, array_join(filter(words, x -> x <> '^'), ' ') AS shape
  FROM (
    SELECT *, {classes} AS words,
      fence OR NOT regexp_like(right(line, 8), '[.?!。？！:]["”’»)\\]*_]*$') AS open_end
    FROM (
      SELECT doc_id, source, n, spoken, fence,
        CASE WHEN spoken THEN 'speech' WHEN line RLIKE '^(```|~~~)' OR fence THEN 'code' ELSE {kind} END AS kind,
        rtrim({blank}, regexp_replace(line, '(?:(?<!\\.)\\.\\.\\.|[…\\x{{FFFD}}]|\\[(?:\\.\\.\\.|…)\\])$', '')) AS line
      FROM (
        SELECT doc_id, source, n, spoken, fence, substring_index(tail, '\n', -1) AS line
        FROM (SELECT doc_id, coalesce(source, '') AS source, length(text) AS n, {spoken_test} AS spoken,
                CASE WHEN contains(text, '```') OR contains(text, '~~~') THEN
                  aggregate(regexp_extract_all(text, '(?m)^[ \\t>]*(?:`{{3,}}[^`\\n]*|~{{3,}}[^\\n]*)$', 0), '', (open, x) -> CASE
                    WHEN open = '' THEN regexp_extract(x, '(`+|~+)', 1)
                    WHEN startswith(trim(' \t>\r' FROM x), open) AND regexp_like(x, '^[ \\t>]*[`~]+\\s*$') THEN '' ELSE open END) <> ''
                  ELSE false END AS fence,
                rtrim({blank}, text) AS tail
              FROM {{documents}} WHERE text IS NOT NULL AND doc_id IS NOT NULL)
        WHERE length(tail) > 0))))
"""

# what stands in lines, by kind of line, inside a line and at its end: trigrams of classes (what 3) and, but for
# prose, words (what 1). Positions and shifted copies in place of lambdas keep the passes in compiled code.
_EACH_LINE = r"""(SELECT line, {kind} AS kind FROM (SELECT rtrim({blank}, raw) AS line FROM (SELECT explode(split(text, '\n')) AS raw FROM {{documents}} WHERE text IS NOT NULL)) WHERE line <> '')"""
_LINES = r"""
SELECT kind, 3 AS what, a || ' ' || b || ' ' || c AS g, inside, ends FROM (
  SELECT kind, a, b, c, count_if(pos < n - 3) AS inside, count_if(pos = n - 3) AS ends FROM (
    SELECT kind, n, pos, z.w AS a, z.`1` AS b, z.`2` AS c FROM (
      SELECT kind, size(w) AS n, posexplode(arrays_zip(w, slice(w, 2, size(w)), slice(w, 3, size(w)))) AS (pos, z) FROM (SELECT kind, {classes} AS w FROM {each_line})))
  WHERE c IS NOT NULL GROUP BY 1, 2, 3, 4)
UNION ALL
SELECT kind, 1 AS what, g, count_if(pos < n - 1) AS inside, count_if(pos = n - 1) AS ends FROM (
  SELECT kind, size(words) AS n, posexplode(words) AS (pos, g) FROM (
    SELECT kind, filter(split(lower(line), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), x -> x <> '') AS words FROM {each_line} WHERE kind <> 'prose'))
GROUP BY 1, 2, 3
"""

# final trigrams that are frequent inside texts and almost never last
_RARE = r"""
WITH inside AS (SELECT kind, {short} AS g, sum(inside) AS inside, sum(ends) AS ends FROM {{lines}} WHERE what = 3 GROUP BY 1, 2),
last AS (SELECT kind, g, count(*) AS last FROM {{features}} WHERE NOT spoken AND kind <> 'code' GROUP BY 1, 2)
SELECT l.kind, l.g FROM last l JOIN inside i ON i.kind = l.kind AND i.g = l.g
WHERE IF(l.kind = 'prose', l.last, i.ends) <= {{terminal}} * (i.inside + IF(l.kind = 'prose', l.last, i.ends))
"""

# last words that tell a cut in lists, tables and headings: those that go on, and those that such lines have nowhere
# else and that begin a known word
_LAST_WORDS = r"""
WITH words AS (SELECT kind, g AS word, inside, ends FROM {lines} WHERE what = 1),
last AS (SELECT kind, word, count(*) AS last FROM {features} WHERE word <> '' GROUP BY 1, 2),
texts AS (SELECT word, sum(last) AS last FROM last GROUP BY word),
total AS (SELECT word, sum(inside + ends) AS n, sum(sum(inside + ends)) OVER () AS every FROM words GROUP BY word),
begun AS (SELECT DISTINCT explode(transform(sequence(1, length(word) - 1), k -> left(word, k))) AS word FROM total WHERE n >= {known} * every AND length(word) > 1)
SELECT l.kind, l.word, false AS new FROM last l JOIN words w ON w.kind = l.kind AND w.word = l.word WHERE w.ends <= {terminal} * (w.inside + w.ends)
UNION
SELECT l.kind, l.word, true FROM last l JOIN texts t ON t.word = l.word JOIN total a ON a.word = l.word LEFT SEMI JOIN begun b ON b.word = l.word WHERE a.n <= t.last AND NOT l.word RLIKE '^[0-9]'
"""

# of the latter those that prose does not have either; without any the texts are not read again
_UNFINISHED = r"""
WITH asked AS (SELECT DISTINCT word FROM {{last_words}} WHERE new),
had AS (SELECT DISTINCT p.word FROM (
  SELECT explode(split(lower(line), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS word FROM (SELECT line, {kind} AS kind FROM (SELECT explode(split(text, '\n')) AS line FROM {{documents}} WHERE text IS NOT NULL)) WHERE kind = 'prose') p
  JOIN asked a ON a.word = p.word)
SELECT l.kind, l.word FROM {{last_words}} l LEFT ANTI JOIN had h ON h.word = l.word AND l.new
"""

_SPOKEN_WORDS = r"""
SELECT word FROM (
  SELECT word, count(*) AS n, sum(count(*)) OVER () AS total
  FROM (SELECT explode(raw) AS word FROM {spoken}) GROUP BY word)
WHERE n >= total * {share}
"""

_SPEECH = r"""
SELECT doc_id, element_at(raw, -1) AS final, transform(raw, x -> CASE WHEN array_contains({listed}, x) THEN x WHEN x RLIKE '^[0-9]+$' THEN 'n' ELSE '~' END) AS w FROM {spoken} WHERE size(raw) > 0
"""

# the final trigram by the class of its last word, and by what the last word begins: a listed word after
# the same two words
_CUT_SPEECH = r"""
WITH inside AS (
  SELECT x.two, x.last, count(*) AS inside
  FROM (SELECT explode(transform(sequence(2, size(w) - 2), i -> struct(w[i - 2] || ' ' || w[i - 1] AS two, w[i] AS last))) AS x FROM {speech} WHERE size(w) > 3) GROUP BY x.two, x.last),
begun AS (SELECT two, opening, sum(inside) AS inside FROM (SELECT two, inside, explode(transform(sequence(1, length(last) - 1), k -> left(last, k))) AS opening FROM inside WHERE last NOT IN ('~', 'n') AND length(last) > 1) GROUP BY two, opening),
ends AS (SELECT doc_id, final, element_at(w, -1) AS last, w[size(w) - 3] || ' ' || w[size(w) - 2] AS two FROM {speech} WHERE size(w) > 2),
whole AS (SELECT two, last, count(*) AS ends FROM ends GROUP BY two, last),
part AS (SELECT two, final, count(*) AS ends FROM ends WHERE last = '~' GROUP BY two, final),
rare AS (SELECT e.two, e.last FROM whole e JOIN inside i ON i.two = e.two AND i.last = e.last WHERE e.ends <= {terminal} * (i.inside + e.ends)),
opened AS (SELECT e.two, e.final FROM part e JOIN begun b ON b.two = e.two AND b.opening = e.final WHERE e.ends <= {terminal} * 20 * (b.inside + e.ends))
SELECT e.doc_id FROM ends e LEFT SEMI JOIN rare r ON r.two = e.two AND r.last = e.last
UNION
SELECT e.doc_id FROM ends e LEFT SEMI JOIN opened o ON o.two = e.two AND o.final = e.final
"""

_VERDICT = r"""
WITH footers AS (
  SELECT shape FROM (SELECT shape, count(*) AS c, sum(count(*)) OVER () AS total FROM {features} GROUP BY shape)
  WHERE shape <> '' AND c >= {footer} * total AND c >= 2),
limits AS (
  SELECT source, n FROM (
    SELECT source, n, c, sum(c) OVER (PARTITION BY source) AS texts,
      (sum(c) OVER (PARTITION BY source ORDER BY n RANGE BETWEEN 40 PRECEDING AND 40 FOLLOWING) - c) / 80.0 AS others
    FROM (SELECT source, n, count(*) AS c FROM {features} GROUP BY source, n))
  WHERE n >= 100 AND c >= 3 AND c >= {limit_share} * texts AND c >= {limit} * others)
SELECT f.doc_id, f.source, CASE WHEN r.g IS NOT NULL OR s.doc_id IS NOT NULL THEN 'trigram' WHEN f.fence THEN 'fence' WHEN u.word IS NOT NULL THEN 'word' ELSE 'limit' END AS evidence, l.n IS NOT NULL AS at_limit
FROM {features} f
LEFT JOIN limits l ON l.source = f.source AND l.n = f.n
LEFT JOIN {cut_speech} s ON s.doc_id = f.doc_id
LEFT JOIN {rare} r ON r.kind = f.kind AND r.g = f.g
LEFT JOIN footers t ON t.shape = f.shape
LEFT JOIN {unfinished} u ON u.kind = f.kind AND u.word = f.word
WHERE f.open_end AND (f.fence OR s.doc_id IS NOT NULL OR u.word IS NOT NULL OR (r.g IS NOT NULL AND (t.shape IS NULL OR f.kind <> 'prose')) OR (f.spoken AND l.n IS NOT NULL))
"""


def _sql(template: str) -> str:
    for name, part in (("each_line", _EACH_LINE), ("classes", _CLASSES), ("short", _SHORT), ("kind", _KIND), ("spoken_test", _SPOKEN.replace("{", "{{").replace("}", "}}")), ("blank", _BLANK)):
        template = template.replace("{" + name + "}", part)
    return template.replace("{{documents}}", "{documents}").replace("{{lines}}", "{lines}").replace("{{features}}", "{features}").replace("{{terminal}}", "{terminal}").replace("{{last_words}}", "{last_words}")


def truncated(documents: DataFrame) -> DataFrame:
    """doc_id, source, evidence of each cut text, and whether its length is a field limit of its source.

    Null, empty and blank texts are whole. Statistics cover all texts; equal
    texts count as often as they stand. Null sources count as one source.
    The few facts kept of each text's end are written once and read by each
    statistic.
    """
    spark = documents.sparkSession
    docs = spread(documents.select("doc_id", "source", "text"))
    features = cut(spark.sql(_sql(_FEATURES), documents=docs))
    spoken = cut(spark.sql("SELECT doc_id, filter(split(lower(text), '\\\\s+'), x -> x <> '') AS raw FROM {documents} WHERE doc_id IS NOT NULL AND length(trim(text)) > 0 AND {spoken_test}".replace("{spoken_test}", _SPOKEN.replace("{", "{{").replace("}", "}}")), documents=docs))
    # at most 1 / SPOKEN_SHARE words: a bound that does not grow with the data
    words = sorted(r.word for r in spark.sql(_SPOKEN_WORDS, spoken=spoken, share=SPOKEN_SHARE).toLocalIterator())
    listed = "array(" + ",".join("'" + w.replace("\\", "\\\\").replace("'", "\\'").replace("{", "{{").replace("}", "}}") + "'" for w in words or [""]) + ")"
    speech = spark.sql(_SPEECH.replace("{listed}", listed), spoken=spoken)
    cut_speech = spark.sql(_CUT_SPEECH, speech=speech, terminal=SPOKEN_TERMINAL)
    lines = cut(spark.sql(_sql(_LINES), documents=docs))
    rare = spark.sql(_sql(_RARE), lines=lines, features=features, terminal=TERMINAL)
    last_words = cut(spark.sql(_LAST_WORDS, features=features, lines=lines, known=KNOWN, terminal=TERMINAL))
    unfinished = spark.sql(_sql(_UNFINISHED), last_words=last_words, documents=docs)
    return spark.sql(_VERDICT, features=features, rare=rare, unfinished=unfinished, cut_speech=cut_speech, footer=FOOTER, limit=LIMIT, limit_share=LIMIT_SHARE)


def truncation_rates(documents: DataFrame) -> DataFrame:
    """source, texts, cut, share of cut texts among the texts that aren't blank."""
    return documents.sparkSession.sql(
        """
        SELECT a.source, a.texts, coalesce(c.cut, 0) AS cut, round(coalesce(c.cut, 0) / a.texts, 6) AS share
        FROM (SELECT coalesce(source, '') AS source, count(*) AS texts FROM {documents} WHERE doc_id IS NOT NULL AND length(trim(text)) > 0 GROUP BY 1) a
        LEFT JOIN (SELECT source, count(*) AS cut FROM {cut} GROUP BY source) c ON c.source = a.source
        """,
        documents=documents,
        cut=truncated(documents),
    )


def found(documents: DataFrame) -> DataFrame:
    return truncated(documents).select("doc_id").distinct()
