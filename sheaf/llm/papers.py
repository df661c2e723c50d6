"""One record for each paper out of many (problem 2).

Membership: records of one paper share a DOI and a title (without subtitle,
markup and case, but with its part number), or a title that only one paper has.
A title is shared by several papers ("Editorial") if its records name two DOIs
of the same registrar kind; such records need a DOI, or the same authors and
year. Keys are compound, so a DOI or title that a third of all records name is
no hot key.

Survivor: token-level consensus. The distinct values of a field are aligned
progressively, heaviest first, against a growing column profile; tokens vote in
each column with the weight of the records that hold them, and the existing
value closest to the winning tokens survives. DOIs vote as well, with weights by
authority: one of a higher kind outweighs all of the lower kinds together.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.operators.components import components
from sheaf.session import cut
from sheaf.sources.tables import latest

FIELDS = ("title", "venue", "authors", "doi")
MANY = 64  # the heaviest values of a field in one paper are aligned; every other votes through the nearest of them
BETWEEN = "\x1f"  # stands between the authors of a list, in no name


def clean_doi(doi: Column) -> Column:
    """A DOI in lower case without prefix, space or trailing stop; null if it is none."""
    d = F.lower(F.regexp_replace(doi, r"[\s\x{200B}\x{FEFF}]+", ""))
    d = F.regexp_replace(d, r"^(?:https?://)?(?:dx\.|www\.)?doi\.org/|^(?:info:)?doi[:/]*(?:https?://(?:dx\.)?doi\.org/)?", "")
    d = F.regexp_replace(d, r"[.,;]+$", "")
    return F.when(d.rlike(r"^10\.\d{3,9}/\S+$"), d)


def title_words(title: Column) -> Column:
    """Title in lower case without markup, braces and punctuation."""
    t = F.regexp_replace(F.lower(title), r"<[^>]*>|[{}$]|\\[a-z]+", "")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}:]+", " "))


def title_key(title: Column) -> Column:
    """The title before its subtitle, and its part number; null without words."""
    t = F.regexp_replace(F.lower(title), r"<[^>]*>|[{}$]", "")
    part = F.regexp_extract(t, r"\b(?:part|pt\.?|volume|vol\.?)\s+([ivx]+|\d+)\b", 1)
    head = F.regexp_replace(t, r"\s*(?::|\s[-\x{2013}\x{2014}]\s)[\s\S]*$", "")
    head = F.when(F.trim(F.regexp_replace(head, r"[^\p{L}\p{N}]+", " ")) == "", t).otherwise(head)
    head = F.regexp_replace(head, r",?\s*\b(?:part|pt\.?)\s+(?:[ivx]+|\d+)\b.*$", "")
    words = F.trim(F.regexp_replace(head, r"[^\p{L}\p{N}]+", " "))
    return F.when(words != "", F.concat_ws("|", words, part))


def doi_kind(doi: Column) -> Column:
    """0 publisher, 1 under 10.1101/, 2 under 10.48550/: the order of authority."""
    return F.when(doi.startswith("10.48550/"), 2).when(doi.startswith("10.1101/"), 1).otherwise(0)


def _author_mark(authors: Column) -> Column:
    """Letters of the longest word of each author, sorted and without repeats: alike for slips and orders."""
    return F.array_join(
        F.array_sort(
            F.transform(
                authors,
                lambda a: F.array_join(F.array_sort(F.array_distinct(F.split(F.element_at(F.array_sort(F.split(F.regexp_replace(F.translate(F.lower(a), "áàâäéèêëíìîïóòôöúùûüøçñ", "aaaaeeeeiiiioooouuuuocn"), r"[^a-z ]", ""), " "), lambda x, y: F.length(x) - F.length(y)), -1), ""))), ""),
            )
        ),
        "|",
    )


def prepared(records: DataFrame) -> DataFrame:
    """Each record once, with clean DOIs, title key and author mark."""
    values = [c for c in ("doi", "title", "authors", "year", "venue", "alt_dois", "added", "score", "confirmed", "source_tool", "bibtex", "notes", "retraction", "orcids") if c in records.columns]
    # re-delivered rows have equal values but for a later time, so any one row will do; the latest is taken
    at = F.coalesce(F.col("added"), F.lit(""))
    best = F.max_by(F.struct(*values), F.struct(at, F.hash(*[F.col(v) for v in values if not dict(records.dtypes)[v].startswith("map")])))
    one = records.where("record_id IS NOT NULL").groupBy("record_id").agg(best.alias("v")).select("record_id", "v.*")
    alts = F.array_distinct(F.filter(F.transform(F.coalesce("alt_dois", F.array().cast("array<string>")), clean_doi), lambda x: x.isNotNull()))
    return one.withColumn("doi", clean_doi(F.col("doi"))).withColumn("alt_dois", alts).withColumn("tkey", title_key(F.col("title"))).withColumn("mark", _author_mark(F.filter(F.coalesce("authors", F.array().cast("array<string>")), lambda a: a.isNotNull())))


def paper_members(one: DataFrame) -> DataFrame:
    """(record_id, component) of prepared records."""
    all_dois = F.array_distinct(F.filter(F.concat(F.array("doi"), "alt_dois"), lambda x: x.isNotNull()))
    base = one.select("record_id", "doi", "tkey", "mark", "year", all_dois.alias("dois"))
    dois = base.select("record_id", "tkey", F.explode("dois").alias("d"))
    # DOIs that several titles name are left out where titles are judged
    titles_of = dois.where("tkey IS NOT NULL").groupBy("d").agg(F.min("tkey").alias("a"), F.max("tkey").alias("b"))
    own = dois.join(titles_of, "d", "left").where("a = b")
    shared = own.withColumn("kind", doi_kind(F.col("d"))).groupBy("tkey", "kind").agg((F.min("d") != F.max("d")).alias("several")).groupBy("tkey").agg(F.max("several").alias("shared"))
    judged = base.select("record_id", "doi", "tkey", "mark", "year").join(shared, "tkey", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    # a DOI of several titles (a volume's) says nothing about a title of several papers ("Preface")
    by_doi = dois.where("tkey IS NOT NULL").join(titles_of, "d").join(shared, "tkey", "left").where(~((F.col("a") != F.col("b")) & F.coalesce("shared", F.lit(False)))).select("record_id", F.concat_ws("\t", F.lit("d"), "d", "tkey").alias("key"))
    by_title = judged.where("tkey IS NOT NULL").select(
        "record_id", F.when(~F.col("shared"), F.concat_ws("\t", F.lit("t"), "tkey")).when(F.col("mark") != "", F.concat_ws("\t", F.lit("a"), "tkey", "mark", F.coalesce(F.col("year").cast("string"), F.lit("")))).alias("key")
    )
    # records without a title: by their own DOI, with the one title that others give it
    untitled = base.where("tkey IS NULL AND doi IS NOT NULL").select("record_id", F.col("doi").alias("d")).join(titles_of, "d", "left")
    by_own = untitled.select("record_id", F.when(F.col("a") == F.col("b"), F.concat_ws("\t", F.lit("d"), "d", "a")).otherwise(F.concat_ws("\t", F.lit("u"), "d")).alias("key"))
    alone = base.select("record_id", F.concat_ws("\t", F.lit("r"), F.col("record_id").cast("string")).alias("key"))
    return components(by_doi.unionByName(by_title).unionByName(by_own).unionByName(alone), "record_id", "key")


def doi_votes(one: DataFrame, members: DataFrame) -> DataFrame:
    """(component, value, weight): the DOIs that a paper's records name, with weights by authority.

    The publisher's comes before 10.1101/ and that before 10.48550/, and one of a
    higher kind outweighs all others. Within a kind the records that have a DOI as
    their own count first, then those that name it. A DOI that other papers name
    too (a volume's), and no record here has as its own, is the least of all.
    """
    named = one.select("record_id", "doi", F.explode(F.array_distinct(F.filter(F.concat(F.array("doi"), "alt_dois"), lambda x: x.isNotNull()))).alias("d")).join(members, "record_id")
    counted = cut(named.groupBy("component", "d").agg(F.count("*").alias("named"), F.sum(F.coalesce((F.col("doi") == F.col("d")).cast("int"), F.lit(0))).alias("own")))
    shared = counted.groupBy("d").agg((F.min("component") != F.max("component")).alias("spread"))
    total = counted.groupBy("component").agg((F.sum("named") + 1).cast("double").alias("t"))
    level = F.when(F.col("spread") & (F.col("own") == 0), 0).otherwise(3 - doi_kind(F.col("d")))
    weight = (F.col("own") * F.col("t") + F.col("named")) * F.pow("t", 3 * level)
    return counted.join(shared, "d").join(total, "component").select("component", F.col("d").alias("value"), weight.alias("weight"))


def tokens(value: str) -> list[str]:
    plain = "".join(c for c in unicodedata.normalize("NFD", value) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", plain.lower())


def consensus(values: list[tuple[str, float]]) -> str:
    """The existing value closest to the tokens that win the vote in each column.

    Values are aligned one after the other, heaviest first (ties: longest, then
    least), against the profile of those before. A token votes with its value's
    weight; a gap votes with half, so that the fuller of two forms wins a tie.
    """
    order = sorted(values, key=lambda v: (-v[1], -len(v[0]), v[0]))
    columns: list[dict[str | None, float]] = []
    seen = 0.0
    for value, weight in order:
        words = tokens(value)
        columns = _join(columns, words, float(weight), seen)
        seen += weight
    winners = [max(c.items(), key=lambda kv: (kv[1] * (0.5 if kv[0] is None else 1.0), kv[0] is not None, kv[0] or "")) for c in columns]
    target = [w for w, _ in winners if w is not None]

    def far(item: tuple[str, float]):
        value, weight = item
        shouting = value.upper() == value and value.lower() != value
        return (_distance(tokens(value), target), bool(re.search(r"[<{]", value)), shouting, value != value.strip(), -weight, value)

    return min(values, key=far)[0]


def _join(columns, words, weight, seen):
    n, m = len(columns), len(words)
    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            agree = columns[i - 1].get(words[j - 1], 0.0)
            score[i][j] = max(score[i - 1][j], score[i][j - 1], score[i - 1][j - 1] + agree + (0.01 if not agree else 1))
    out, i, j = [], n, m
    while i or j:
        agree = columns[i - 1].get(words[j - 1], 0.0) if i and j else 0.0
        if i and j and abs(score[i][j] - (score[i - 1][j - 1] + agree + (0.01 if not agree else 1))) < 1e-9:
            c = dict(columns[i - 1])
            c[words[j - 1]] = c.get(words[j - 1], 0.0) + weight
            i, j = i - 1, j - 1
        elif i and (not j or score[i][j] == score[i - 1][j]):
            c = dict(columns[i - 1])
            c[None] = c.get(None, 0.0) + weight
            i -= 1
        else:
            c = {words[j - 1]: weight, **({None: seen} if seen else {})}
            j -= 1
        out.append(c)
    return out[::-1]


def _distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


_VOTE = pa.schema([("component", pa.int64()), ("field", pa.string()), ("value", pa.string()), ("weight", pa.float64())])
_VOTE_DDL = "component long, field string, value string, weight double"


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for component, field, values in zip(*(batch.column(i).to_pylist() for i in range(3))):
            rows.append((component, field, consensus([(v["value"], v["weight"]) for v in values]), sum(v["weight"] for v in values)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 4, _VOTE)], schema=_VOTE)


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A value's vote goes to the heavy value with the least token distance, the heaviest of those."""
    for batch in batches:
        component, field, value, weight, heavy = (batch.column(i).to_pylist() for i in range(5))
        to = [min(enumerate(h), key=lambda kv: (_distance(tokens(v), tokens(kv[1]["value"])), kv[0]))[1]["value"] for v, h in zip(value, heavy)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((component, field, to, weight), _VOTE)], schema=_VOTE)


def _elect(values: DataFrame) -> DataFrame:
    """The consensus value of each (component, field) from (component, field, value, weight).

    Distinct values are counted before they meet, so a copy costs nothing. The
    MANY heaviest of a field are aligned; each other value adds its weight to the
    nearest of them, in a row of its own. So every value votes, one rule holds at
    every size, and no row holds more than MANY values.
    """
    keys = ["component", "field"]
    counted = values.groupBy(*keys, "value").agg(F.sum("weight").alias("weight"))
    ranked = cut(counted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("weight"), "value"))))
    heavy = ranked.where(F.col("rank") <= MANY).select(*keys, "value", "weight")
    list_of = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "value"))), lambda x: F.struct(x["value"].alias("value")))
    rest = ranked.where(F.col("rank") > MANY).join(heavy.groupBy(*keys).agg(list_of.alias("heavy")), keys)
    added = rest.select(*keys, "value", "weight", "heavy").mapInArrow(_nearest, _VOTE_DDL)
    votes = heavy.unionByName(added).groupBy(*keys, "value").agg(F.sum("weight").alias("weight"))
    return votes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("value", "weight"))).alias("v")).select(*keys, "v").mapInArrow(_vote, _VOTE_DDL)


def merged_papers(records: DataFrame) -> DataFrame:
    """One record for each paper: doi, alt_dois, title, authors, year, venue and the rest, field by field.

    Titles, venues and author lists come by consensus (full venues outvote
    shortened ones, as a preprint server's name stands only where nothing else
    does); the year is the most frequent, then the latest; orcids are united by the
    name as typed;
    flags are true if any is; notes, bibtex and retraction are those of the
    latest record that has one. Null fields never displace a value.
    """
    one = cut(prepared(records))
    members = cut(paper_members(one))
    out = _survivors(one, members)
    if "orcids" in one.columns:
        each = one.join(members, "record_id").select("component", F.explode("orcids").alias("name", "orcid")).where("name IS NOT NULL AND orcid IS NOT NULL")
        united = each.groupBy("component", "name").agg(F.max("orcid").alias("orcid")).groupBy("component").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "orcid")))).alias("orcids"))
        out = out.join(united, "component", "left")
    return out


def _survivors(one: DataFrame, members: DataFrame) -> DataFrame:
    rows = one.join(members, "record_id")
    venue = F.trim("venue")
    # a venue in full words is worth more than a shortened one, a server's name less than any
    worth = F.when(F.lower(venue).rlike(r"^(arxiv|biorxiv|medrxiv)?\s*(preprint)?$"), 1).when(venue.rlike(r"\.( |$)"), 4).otherwise(16)
    fields = (
        rows.where(F.trim("title") != "").select("component", F.lit("title").alias("field"), F.col("title").alias("value"), F.lit(1.0).alias("weight"))
        .unionByName(rows.where(venue != "").select("component", F.lit("venue").alias("field"), venue.alias("value"), worth.cast("double").alias("weight")))
        .unionByName(rows.where(F.size("authors") > 0).select("component", F.lit("authors").alias("field"), F.array_join("authors", BETWEEN).alias("value"), F.size("authors").cast("double").alias("weight")))
        .unionByName(doi_votes(one, members).select("component", F.lit("doi").alias("field"), "value", "weight"))
    )
    elected = _elect(fields).groupBy("component").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS])
    years = rows.where("year IS NOT NULL").groupBy("component", "year").agg(F.count("*").alias("n")).groupBy("component").agg(F.max(F.struct("n", "year")).alias("y")).select("component", F.col("y.year").alias("year"))
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.coalesce("added", F.lit("")), "record_id"))).alias(c)
    rest = rows.groupBy("component").agg(
        F.count("*").alias("records"),
        F.min("added").alias("added"),
        F.max("score").alias("score"),
        F.coalesce(F.max("confirmed"), F.lit(False)).alias("confirmed"),
        newest("notes"),
        newest("bibtex"),
        newest("source_tool"),
        newest("retraction"),
    )
    named = one.select("record_id", F.explode(F.concat(F.array("doi"), "alt_dois")).alias("d")).where("d IS NOT NULL").join(members, "record_id").groupBy("component").agg(F.sort_array(F.collect_set("d")).alias("dois"))
    out = rest.join(elected, "component", "left").join(named, "component", "left").join(years, "component", "left")
    return out.withColumn("alt_dois", F.array_remove("dois", F.col("doi"))).drop("dois").withColumn("authors", F.split("authors", BETWEEN))


def found(records: DataFrame) -> DataFrame:
    """Every record of a paper with two or more records, with the surviving DOI (null if none of them has one).

    The DOI is the one the consensus elects.
    """
    one = cut(prepared(records))
    members = cut(paper_members(one))
    elected = _elect(doi_votes(one, members).select("component", F.lit("doi").alias("field"), "value", "weight")).select("component", F.col("value").alias("doi"))
    papers = members.groupBy("component").agg(F.count("*").alias("records")).where("records >= 2").join(elected, "component", "left")
    return members.join(papers, "component").select("record_id", "doi")
