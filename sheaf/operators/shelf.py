"""Citation store: upserts by shared DOIs, buckets, exports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import doi_rank
from sheaf.operators.components import components


def rank_of(doi: str) -> int:
    return 0 if doi.startswith("10.48550/arXiv.") else 1 if doi.startswith("10.1101/") else 2


def upsert(store: dict[str, dict], record: dict) -> str | None:
    """Track a record in a store keyed by DOI; returns a note on notable events.

    The first match counts: the record's DOI as a key, its alternates as keys, then any
    shared alternate in the store's order. Score, confirmation, notes and the time of
    adding stay; the highest DOI becomes the key, ties by the least DOI (a choice of
    ours); a retraction never goes away.
    """
    record = dict(record, alt_dois=list(record.get("alt_dois") or []))
    dois = [record["doi"], *record["alt_dois"]]
    match = None
    for bucket in (True, False) if record.get("retraction") is not None else (True, False):
        keys = [k for k, r in store.items() if (r.get("retraction") is not None) == bucket]
        match = next((d for d in dois if d in keys), None) or next((k for k in keys if set(dois) & set(store[k]["alt_dois"])), None)
        if match:
            break
    note = None
    if match:
        old = store.pop(match)
        if record.get("retraction") is not None and old.get("retraction") is None:
            note = "existing shelf entry moved to retracted bucket (not citable)"
        for keep in ("score", "confirmed", "notes", "added"):
            record[keep] = old.get(keep)
        record["retraction"] = record.get("retraction") if record.get("retraction") is not None else old.get("retraction")
        every = {*dois, old["doi"], *old["alt_dois"]}
        record["doi"] = min(every, key=lambda x: (-rank_of(x), x))
        record["alt_dois"] = sorted(every - {record["doi"]})
    elif record.get("retraction") is not None:
        note = "tracked in retracted shelf bucket (not added to active citations)"
    store[record["doi"]] = record
    return note


_OUT = pa.schema([("shelf", pa.int64()), ("doi", pa.string()), ("alt_dois", pa.list_(pa.string())), ("title", pa.string()), ("added", pa.string()), ("score", pa.int32()), ("confirmed", pa.bool_()), ("retracted", pa.bool_()), ("note", pa.string())])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for shelf, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            store: dict[str, dict] = {}
            notes = [upsert(store, r) for r in records]
            last = next((n for n in reversed(notes) if n), None)
            rows += [(shelf, r["doi"], r["alt_dois"], r["title"], r["added"], r["score"], r["confirmed"], r["retraction"] is not None, last) for r in store.values()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(_OUT), _OUT)], schema=_OUT)


def fold_shelf(records: DataFrame) -> DataFrame:
    """The store after all records were tracked in order of ``added`` and record_id.

    Records of different papers never meet, so each connected component of shared
    DOIs is folded by itself, in arrival order. Records without a DOI are left out.
    """
    r = records.where("doi IS NOT NULL AND record_id IS NOT NULL").dropDuplicates(["record_id"]).withColumn("alt_dois", F.filter(F.coalesce("alt_dois", F.array().cast("array<string>")), lambda x: x.isNotNull()))
    members = components(r.select("record_id", F.explode(F.array_union(F.array("doi"), "alt_dois")).alias("key")), "record_id", "key")
    fields = F.struct(F.coalesce("added", F.lit("")).alias("at"), "record_id", "doi", "alt_dois", "title", "added", "score", "confirmed", "notes", "retraction")
    groups = r.join(members, "record_id").groupBy("component").agg(F.sort_array(F.collect_list(fields)).alias("rs"))
    ddl = "shelf long, doi string, alt_dois array<string>, title string, added string, score int, confirmed boolean, retracted boolean, note string"
    return groups.select("component", "rs").mapInArrow(_fold, ddl)


def resolve(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """(doi, key, bucket): a DOI's record, a key before an alternate, the active before the retracted."""
    names = store.select("doi", "retracted", F.explode(F.array(F.struct(F.col("doi").alias("d"), F.lit(0).alias("t")))).alias("x")).select("doi", "retracted", "x.*").unionByName(store.select("doi", "retracted", F.explode("alt_dois").alias("d"), F.lit(1).alias("t")))
    hits = wanted.withColumnRenamed("doi", "d").join(names, "d").groupBy("d").agg(F.min_by(F.struct("doi", "retracted"), F.struct("t", "retracted", "doi")).alias("m"))
    out = wanted.join(hits.withColumnRenamed("d", "wanted"), F.col("doi") == F.col("wanted"), "left")
    return out.select(wanted["doi"], F.col("m.doi").alias("key"), F.when(F.col("m.retracted"), "retracted").when(~F.col("m.retracted"), "active").alias("bucket"))


def escape(text: Column) -> Column:
    for c in "&%#_":
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


def entry_key(authors: Column, year: Column) -> Column:
    """First author's family name and the year."""
    first = F.get(authors, F.lit(0))
    family = F.when(F.contains(first, F.lit(",")), F.split(first, ",")[0]).otherwise(F.element_at(F.split(F.trim(first), r"\s+"), -1))
    return F.concat(F.coalesce(F.lower(F.regexp_replace(family, "[^a-zA-Z]", "")), F.lit("unknown")), F.coalesce(F.nullif(year, F.lit(0)).cast("int").cast("string"), F.lit("nd")))


def bibtex(r: DataFrame) -> DataFrame:
    """Adds entry: the stored BibTeX, or one made of the fields there are."""
    field = lambda name, value: F.concat(F.lit(f"  {name} = {{"), value, F.lit("}"))
    arxiv = F.regexp_extract("doi", r"^10\.48550/arXiv\.(.+)$", 1)
    fields = F.concat_ws(
        ",\n",
        F.when(F.size("authors") > 0, field("author", escape(F.array_join("authors", " and ")))),
        field("title", escape(F.coalesce("title", F.lit("")))),
        F.when(F.col("year") > 0, field("year", F.col("year").cast("int").cast("string"))),
        F.when(F.col("venue") != "", field("journal", escape(F.col("venue")))),
        F.when(F.col("doi") != "", field("doi", F.col("doi"))),
        F.when(arxiv != "", F.concat(field("eprint", arxiv), F.lit(",\n  archivePrefix = {arXiv}"))),
    )
    made = F.concat(F.lit("@misc{"), entry_key(F.col("authors"), F.col("year")), F.lit(",\n"), fields, F.lit("\n}"))
    return r.withColumn("entry", F.coalesce(F.nullif(F.trim("bibtex"), F.lit("")), made))


def ris(r: DataFrame) -> DataFrame:
    """Adds entry in RIS."""
    tag = lambda t, v: F.concat(F.lit(f"{t}  - "), v)
    authors = F.nullif(F.array_join(F.transform("authors", lambda a: F.concat(F.lit("AU  - "), a)), "\n"), F.lit(""))
    return r.withColumn("entry", F.concat_ws("\n", F.lit("TY  - GEN"), authors, tag("TI", F.coalesce("title", F.lit(""))), F.when(F.col("venue") != "", tag("JO", F.col("venue"))), F.when(F.col("year") > 0, tag("PY", F.col("year").cast("int").cast("string"))), F.when(F.col("doi") != "", tag("DO", F.col("doi"))), F.lit("ER  - ")))


def listing(r: DataFrame) -> DataFrame:
    """Adds line: a row of the table of records, titles cut at 50 characters."""
    title = F.when(F.length("title") > 50, F.concat(F.left("title", F.lit(50)), F.lit("..."))).otherwise(F.coalesce("title", F.lit("")))
    cell = lambda c: F.coalesce(c, F.lit("—"))
    return r.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", cell(F.col("score").cast("int").cast("string")), F.when(F.col("confirmed"), "confirmed").otherwise(""), title, cell(F.col("doi")), cell(F.col("source_tool"))), F.lit(" |")))


def best_doi(dois: Column) -> Column:
    """The highest DOI of an array, ties by the least."""
    return F.get(F.array_sort(F.transform(dois, lambda x: F.struct((-doi_rank(x)).alias("r"), x.alias("d")))), F.lit(0))["d"]


def apply_commands(store: DataFrame, commands: DataFrame) -> DataFrame:
    """The store after commands in order of ``pos``: remove, score, confirm, note. Commands for one record
    fold to its last score and note, whether it was ever confirmed, and whether it is removed at last;
    commands for DOIs that are not there do nothing."""
    c = commands.groupBy("doi").agg(
        F.max_by("value", F.when(F.col("action") == "score", F.col("pos"))).alias("new_score"),
        F.max_by("value", F.when(F.col("action") == "note", F.col("pos"))).alias("new_note"),
        F.max(F.col("action") == "confirm").alias("confirms"),
        F.max(F.col("action") == "remove").alias("removed"),
    )
    out = store.join(c, "doi", "left").where(~F.coalesce("removed", F.lit(False)))
    return out.withColumn("score", F.coalesce(F.col("new_score").cast("int"), "score")).withColumn("notes", F.coalesce("new_note", "notes")).withColumn("confirmed", F.coalesce("confirms", F.lit(False)) | F.coalesce("confirmed", F.lit(False))).drop("new_score", "new_note", "confirms", "removed")
