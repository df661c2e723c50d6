"""Documents made of rows: issues, pull requests, repositories, models, listings, transcripts, sections of pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.text import clock


def lines_of(df: DataFrame, key: list[str], order: list[str], line: Column, sep: str = "\n", name: str = "text") -> DataFrame:
    """One text for each key from its lines in order. For what a person reads: lists of bounded length."""
    return df.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("_l")))), lambda x: x["_l"]), sep).alias(name))


def issue_lines(issues: DataFrame, comments: DataFrame, most: int = 30) -> DataFrame:
    """(issue, part, pos, line): an issue's head, body and first ``most`` comments as rows of one document, in order of
    part and pos. Rows, not one text: an issue may have any number of comments."""
    said = F.when(F.coalesce("association", F.lit("NONE")) != "NONE", F.concat(F.lit(" ("), "association", F.lit(")"))).otherwise("")
    n = comments.groupBy("issue").agg(F.count("*").alias("n"))
    head = issues.join(n, "issue", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    meta = F.concat(F.lit("**"), "repo", F.lit("#"), F.col("issue").cast("string"), F.lit("** | "), "state", F.lit(" | "), F.col("n").cast("string"), F.lit(" comments"))
    hint = F.when(F.col("n") > most, F.concat(F.lit(f"Showing {most} of "), F.col("n").cast("string"), F.lit(" comments. Use page= for more.")))
    parts = F.filter(F.array(F.struct(F.lit(0).alias("part"), meta.alias("line")), F.struct(F.lit(1).alias("part"), F.concat(F.lit("**@"), "author", F.lit("**"), said).alias("line")), F.struct(F.lit(2).alias("part"), F.col("body").alias("line")), F.struct(F.lit(3).alias("part"), hint.alias("line"))), lambda x: x["line"].isNotNull())
    rows = head.select("issue", F.explode(parts).alias("p")).select("issue", "p.part", F.lit(0).cast("bigint").alias("pos"), "p.line")
    k = F.row_number().over(Window.partitionBy("issue").orderBy("id", "author", "association", "body"))
    each = comments.withColumn("k", k).where(F.col("k") <= most)
    text = F.concat(F.lit("### ic_"), F.col("id").cast("string"), F.lit("\n\n**@"), "author", F.lit("**"), said, F.lit("\n\n"), F.coalesce("body", F.lit("")))
    return rows.unionByName(each.select("issue", F.lit(4).alias("part"), F.col("k").cast("bigint").alias("pos"), text.alias("line")))


def pull_files(files: DataFrame, most: int = 100) -> DataFrame:
    """(pull, text): the files a pull request changes, the first ``most`` by path, with how many more there are."""
    per = Window.partitionBy("pull")
    f = files.withColumn("k", F.row_number().over(per.orderBy("path"))).withColumn("n", F.count("*").over(per)).where(F.col("k") <= most)
    line = F.concat(F.lit("- `"), "path", F.lit("` (+"), F.col("added").cast("string"), F.lit(" −"), F.col("removed").cast("string"), F.lit(")"))
    more = F.when(F.max("n") > most, F.concat(F.lit("\n- … and "), (F.max("n") - most).cast("string"), F.lit(" more"))).otherwise("")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", line.alias("_l")))), lambda x: x["_l"]), "\n")
    return f.groupBy("pull").agg(F.concat(body, more).alias("text"))


def template_notes(files: DataFrame) -> DataFrame:
    """(repo, forms, templates, blank, note): what a repository's folder of issue templates asks of those who write."""
    name = F.element_at(F.split("path", "/"), -1)
    config = name.isin("config.yml", "config.yaml")
    f = files.where("path LIKE '.github/ISSUE_TEMPLATE/%'").groupBy("repo").agg(
        F.count_if(name.rlike(r"\.ya?ml$") & ~config).alias("forms"),
        F.count_if(name.rlike(r"\.md$")).alias("templates"),
        F.coalesce(F.min(F.when(config, ~F.coalesce("content", F.lit("")).rlike(r"(?m)^blank_issues_enabled:\s*false"))), F.lit(True)).alias("blank"),
    )
    note = F.concat_ws("; ", F.when(F.col("forms") > 0, F.concat(F.col("forms").cast("string"), F.lit(" issue forms"))), F.when(F.col("templates") > 0, F.concat(F.col("templates").cast("string"), F.lit(" templates"))), F.when(~F.col("blank"), "blank issues are off"))
    return f.where("forms + templates > 0 OR NOT blank").withColumn("note", note)


def video_document(listing: DataFrame, key: str) -> DataFrame:
    """(key, text): a channel, playlist or search as a document; without entries it says so."""
    minutes = F.when(F.col("duration").isNotNull(), F.concat(F.lit(" ("), clock(F.col("duration")), F.lit(")"))).otherwise("")
    line = F.when(F.col("id").isNotNull(), F.concat((F.col("pos") + 1).cast("string"), F.lit(". "), F.coalesce("title", F.lit("Untitled")), minutes))
    n = F.count("id")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("_l")))), lambda x: x["_l"]), "\n")
    return listing.groupBy(key).agg(F.concat(F.lit("## Recent uploads ("), n.cast("string"), F.lit(")\n\n"), F.when(n == 0, "(no entries)").otherwise(body)).alias("text"))


def transcript_lines(segments: DataFrame, chapters: DataFrame, key: str) -> DataFrame:
    """(key, part, at, pos, line): a transcript as rows of one document: its chapters as contents, then under the
    heading of each chapter what is said from its start on. Rows, as a live stream's transcript has no bound."""
    c = chapters.where("title IS NOT NULL AND start_time IS NOT NULL").select(key, F.col("start_time").alias("at"), "pos", "title")
    contents = c.select(key, F.lit(0).alias("part"), "at", F.col("pos").cast("bigint").alias("pos"), F.concat(F.lit("- ["), clock(F.col("at")), F.lit("] "), "title").alias("line"))
    heads = c.select(key, F.lit(1).alias("part"), "at", F.lit(-1).cast("bigint").alias("pos"), F.concat(F.lit("## "), "title").alias("line"))
    said = segments.select(key, F.lit(1).alias("part"), F.col("start").alias("at"), F.col("seg_idx").cast("bigint").alias("pos"), F.concat(F.lit("["), clock(F.col("start")), F.lit("] "), "text").alias("line"))
    return contents.unionByName(heads).unionByName(said)


def quota_warning(remaining: Column, limit: Column, token: Column, least: int = 10) -> Column:
    """A warning where few requests are left and no token lifts the limit."""
    return F.when((remaining < least) & ~token, F.concat(F.lit("GitHub API rate limit low ("), remaining.cast("string"), F.lit("/"), limit.cast("string"), F.lit(" remaining). Set GITHUB_TOKEN for 5000 req/hr.")))


def model_hints(models: DataFrame, siblings: DataFrame) -> DataFrame:
    """(repo, hints): files to look at next, only such as the repository has, and the model it derives from."""
    have = siblings.groupBy("repo").agg(F.sort_array(F.collect_set(F.when(F.col("path").isin("config.json", "model.safetensors.index.json"), F.col("path")))).alias("files"))
    m = models.join(have, "repo", "left")
    listed = F.array_join(F.transform(F.coalesce("files", F.array().cast("array<string>")), lambda f: F.concat(F.lit("'"), F.col("repo"), F.lit("/"), f, F.lit("'"))), " or ")
    return m.select("repo", F.concat_ws(" | ", F.when(listed != "", F.concat(F.lit("see "), listed, F.lit(" for the full document"))), F.when(F.col("base").isNotNull(), F.concat(F.lit("base model "), "base"))).alias("hints"))


def label_advice(searches: DataFrame, labels: DataFrame) -> DataFrame:
    """(query, advice): for a search by label and repository that found nothing, the labels the repository has."""
    repo = F.coalesce(F.nullif(F.regexp_extract("query", r'\brepo:"([^"]+)"', 1), F.lit("")), F.nullif(F.regexp_extract("query", r"\brepo:([^\s\"]+)", 1), F.lit("")))
    asked = F.coalesce(F.nullif(F.regexp_extract("query", r'\blabel:"([^"]+)"', 1), F.lit("")), F.nullif(F.regexp_extract("query", r"\blabel:([^\s\"]+)", 1), F.lit("")))
    s = searches.where("hits = 0").withColumn("repo", repo).withColumn("asked", asked).where("repo IS NOT NULL AND asked IS NOT NULL")
    names = labels.where("name IS NOT NULL").groupBy("repo").agg(F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("names"))
    return s.join(names, "repo").select("query", F.concat(F.lit("label:"), "asked", F.lit(" matched nothing — "), "repo", F.lit(" uses: "), "names").alias("advice"))


def citation_file(cff: Column) -> Column:
    """doi, title, authors and year of a citation file: those of the preferred citation where it has one, else its own."""
    def read(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            top = _yaml(t or "")
            own = top.get("preferred-citation") if isinstance(top.get("preferred-citation"), dict) else top
            pick = lambda k, o=own, d=top: o.get(k) or d.get(k)
            people = []
            for a in pick("authors") or []:
                family, given = a.get("family-names"), a.get("given-names")
                people += [f"{family}, {given}" if family and given else family or a.get("name")]
            year = str(pick("date-released") or "")[:4] or str(pick("year") or "")
            rows.append((pick("doi"), pick("title") or "Untitled", "; ".join(p for p in people if p), int(year) if year.isdigit() else None))
        return pd.DataFrame(rows, columns=["doi", "title", "authors", "year"]).astype({"year": "Int32"})

    return F.pandas_udf(read, "doi string, title string, authors string, year int")(cff)


def _yaml(text: str) -> dict:
    """Maps, lists of maps and plain values by indentation: as much of the format as citation files use."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#")]
    at = 0

    def value(raw: str):
        return raw.strip().strip("\"'")

    def block(depth: int):
        nonlocal at
        out: dict | list = [] if at < len(lines) and lines[at][1].startswith("- ") else {}
        while at < len(lines) and lines[at][0] == depth:
            line = lines[at][1]
            if isinstance(out, list):
                if not line.startswith("- "):
                    break
                lines[at] = (depth + 2, line[2:].strip())
                out.append(block(depth + 2) if ":" in lines[at][1] else value(lines[at][1]))
                if not isinstance(out[-1], dict):
                    at += 1
                continue
            name, _, rest = line.partition(":")
            at += 1
            if rest.strip():
                out[name.strip()] = value(rest)
            elif at < len(lines) and (lines[at][0] > depth or lines[at][0] == depth and lines[at][1].startswith("- ")):
                out[name.strip()] = block(lines[at][0])
        return out

    found = block(lines[0][0]) if lines else {}
    return found if isinstance(found, dict) else {}


def repository_records(repos: DataFrame) -> DataFrame:
    """Repositories as records of the citation store, under a key of their own."""
    return repos.select(F.concat(F.lit("github:"), F.lower("repo")).alias("doi"), F.col("repo").alias("title"), F.array().cast("array<string>").alias("alt_dois"), F.lit("github").alias("source_tool"))
