"""The engine's methods: one for each thing a user asks of a collection of documents.

Every method takes DataFrames and typed arguments and gives a DataFrame; nothing
is collected. Metadata and page sources are tables or payload tables; live
fetching is left to whoever fills them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.functions import urls
from sheaf.operators import html, search, shelf, structure, timed
from sheaf.operators.threads import thread_tree


class Engine:
    """Queries over documents (key, text), transcripts and citation records."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def route(self, requests: DataFrame, url: str = "url") -> DataFrame:
        """Which source answers each URL, and the fragment that names a section."""
        return requests.withColumn("route", urls.route(F.col(url))).withColumn("fragment", urls.fragment(F.col(url)))

    def normalise(self, pages: DataFrame, key: str, body: str = "html") -> DataFrame:
        """Title and Markdown of HTML pages."""
        return html.markdown_pages(pages, key, F.col(body))

    def contents(self, docs: DataFrame, key: str, text: str, page: int = 0, size: int = 100) -> DataFrame:
        """One page of each document's contents; negative pages count from the end."""
        toc = structure.table_of_contents(structure.sections(docs, key, text), key, "idx")
        total = F.count("*").over(Window.partitionBy(key))
        at = structure.contents_page(total, F.lit(page), size)
        return toc.withColumn("_p", at).where((F.col("idx") >= F.col("_p.start")) & (F.col("idx") < F.col("_p.start") + size)).select(key, "idx", "line", F.col("_p.page").alias("page"), F.col("_p.pages").alias("pages"))

    def section(self, docs: DataFrame, key: str, text: str, names: list[str], expand: bool = False) -> DataFrame:
        """The named sections' text; with expand also what is filed under them. Names that match nothing
        come out with a null text."""
        secs = structure.with_subtree_end(structure.sections(docs, key, text), key, "idx")
        asked = docs.select(key).distinct().withColumn("req", F.explode(F.array(*map(F.lit, names))))
        hits = structure.matched_sections(secs.drop("subtree_end"), asked, key)
        spans = secs.select(key, "idx", "start_pos", F.col("subtree_end" if expand else "end_pos").alias("stop"))
        out = hits.join(spans, [key, "idx"], "left").join(docs.select(key, F.col(text).alias("_t")), key)
        return out.select(key, "req", "idx", F.btrim(F.substring("_t", F.col("start_pos") + 1, F.col("stop") - F.col("start_pos")), F.lit(" \t\r\n")).alias("text"))

    def slices(self, docs: DataFrame, key: str, text: str, wanted: list[int], tokens: int = 4000) -> DataFrame:
        """Slices by number within a budget of four characters a token, with their place in the sections."""
        c = structure.chunks(docs, key, text)
        placed = c.join(structure.slice_ancestry(c, structure.sections(docs, key, text), key), [key, "idx"], "left")
        chosen = placed.where(F.col("idx").isin(wanted)).withColumn("_n", F.length("text") + F.length(F.coalesce("ancestry", F.lit(""))) + 20)
        return structure.within_budget(chosen, key, "idx", F.col("_n"), tokens * 4).drop("_n")

    def search(self, docs: DataFrame, key: str, text: str, query: str, limit: int = 50) -> DataFrame:
        """Rows that match a query, best first. A query's warnings are in search.Query(query).warnings."""
        q = search.Query(query)
        hits = search.matching(docs, key, text, query)
        if not q.terms:
            return hits.withColumn("score", F.lit(0.0)).orderBy(key).limit(limit)
        scored = search.bm25(docs, key, text, q.terms, limit=None)
        return hits.join(scored, key, "left").withColumn("score", F.coalesce("score", F.lit(0.0))).orderBy(F.desc("score"), key).limit(limit)

    def search_pages(self, docs: DataFrame, key: str, text: str, query: str, limit: int = 50) -> DataFrame:
        """Slices that match within each page, by the page's own statistics."""
        c = structure.chunks(docs, key, text).withColumn("w", search.terms(F.col("text")))
        q = search.Query(query)
        page = Window.partitionBy(key)
        n, avg = F.count("*").over(page), F.avg(F.size("w")).over(page)
        score = F.lit(0.0)
        for t in dict.fromkeys(q.terms):
            tf = (F.size("w") - F.size(F.array_remove("w", t))).cast("double")
            df = F.sum((tf > 0).cast("int")).over(page)
            score = score + F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.size("w") / avg))
        hits = c.withColumn("score", F.round(score, 6)).where(q.condition(F.col("w")))
        k = F.row_number().over(page.orderBy(F.desc("score"), "idx"))
        return hits.withColumn("k", k).where(F.col("k") <= limit).select(key, "idx", "score")

    def transcript(self, segments: DataFrame, key: str, query: str | None = None, start: float | None = None, end: float | None = None) -> DataFrame:
        """Windows of transcripts that match a query and overlap a half-open range of seconds."""
        aware = segments if "aware" in segments.columns else segments.withColumn("aware", F.lit(False))
        w = timed.windows(aware, key, ["start"]).groupBy(key, "win").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("duration")).alias("stop"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), " ").alias("text"))
        if end is not None:
            w = w.where(F.col("start") < end)
        if start is not None:
            w = w.where(F.col("stop") > start)
        return w.where(search.Query(query).condition(search.terms(F.col("text")))) if query else w

    def thread(self, posts: DataFrame, thread: str, node: str, parent: str) -> DataFrame:
        """The tree of a thread in reading order of ``path``."""
        return thread_tree(posts, thread, node, parent)

    def shelf(self, records: DataFrame, include_retracted: bool = False) -> DataFrame:
        """Tracked citations; retracted ones only on request."""
        s = shelf.fold_shelf(records)
        return s if include_retracted else s.where("NOT retracted")

    def export(self, records: DataFrame, form: str = "bibtex") -> DataFrame:
        """Citations as BibTeX or RIS entries, in order of adding."""
        if form not in ("bibtex", "ris"):
            raise ValueError("form is bibtex or ris")
        out = shelf.bibtex(records) if form == "bibtex" else shelf.ris(records)
        return out.select("record_id", F.coalesce("added", F.lit("")).alias("added"), "entry")
