"""Metadata documents as Markdown: packages, projects, papers, errors, banners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.text import severity


def banner(r: DataFrame) -> DataFrame:
    """Adds banner: the block quote that goes above a retracted, doubted or corrected paper."""
    tag = F.when(F.col("class") == "retraction", "[RETRACTED]").when(F.col("class") == "expression_of_concern", "[EXPRESSION OF CONCERN]").when(F.col("class") == "correction", "[CORRECTED]")
    verb = F.when(F.col("class") == "retraction", "This paper has been retracted").when(F.col("class") == "expression_of_concern", "The validity of this paper has been called into question").otherwise("This paper has been corrected")
    body = F.concat_ws(" ", verb, F.concat(F.lit("on "), "date"), F.concat(F.lit("— notice: https://doi.org/"), "notice_doi"))
    return r.withColumn("banner", F.concat(F.lit("> **"), tag, F.lit("** "), body, F.lit(".")))


def error_text(url: Column, status: Column, text: Column, most: int = 600) -> Column:
    """An HTTP error with what the server said, at most ``most`` characters of it."""
    bare = F.concat(F.lit("Error: HTTP "), status.cast("string"), F.lit(" for "), url)
    t = F.trim(F.coalesce(text, F.lit("")))
    cut = F.when(F.length(t) > most, F.concat(F.rtrim(F.left(t, F.lit(most))), F.lit(" …"))).otherwise(t)
    return F.when(t == "", bare).otherwise(F.concat(bare, F.lit("\n\nThe server returned an error page:\n\n"), cut))


def advisory(a: DataFrame) -> DataFrame:
    """(id, text) of security advisories."""
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), "id", F.lit("\n")),
        F.concat(F.lit("**Title:** "), F.nullif("title", F.lit(""))),
        F.concat(F.lit("**CVEs:** "), F.nullif("aliases", F.lit(""))),
        F.concat(F.lit("**CVSS:** "), F.col("score").cast("string"), F.lit(" ("), severity(F.col("score")), F.lit(")")),
        F.concat(F.lit("**OSV:** "), F.nullif("url", F.lit(""))),
    )
    return a.select("id", lines.alias("text"))


def version_table(versions: DataFrame, most: int = 20) -> DataFrame:
    """(package, text): the newest versions as a table, with a note on those left out."""
    per = Window.partitionBy("package")
    v = versions.withColumn("k", F.row_number().over(per.orderBy(F.desc_nulls_last("published"), F.desc("version")))).withColumn("total", F.count("*").over(per)).where(F.col("k") <= most)
    row = F.concat(F.lit("| "), "version", F.lit(" | "), F.coalesce(F.left("published", F.lit(10)), F.lit("")), F.lit(" | "), F.when(F.col("deprecated"), "yes").otherwise(""), F.lit(" |"))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", row.alias("r")))), lambda x: x["r"]), "\n")
    note = F.when(F.max("total") > most, F.concat(F.lit(f"\n\n*{most} of "), F.max("total").cast("string"), F.lit(" versions shown.*"))).otherwise("")
    return v.groupBy("package").agg(F.concat(F.lit("## Recent Versions\n\n| Version | Published | Deprecated |\n|---------|-----------|------------|\n"), rows, note).alias("text"))


def enriched_papers(base: DataFrame, citation: DataFrame, registry: DataFrame) -> DataFrame:
    """Papers with their citation text and registry facts by DOI; a side that is missing drops no paper."""
    return base.join(citation, "doi", "left").join(registry, "doi", "left").withColumn("title", F.coalesce("title", "registry_title", F.lit("Untitled"))).drop("registry_title")


def quant_verdict(r: DataFrame) -> DataFrame:
    """Adds is_quant, native and reason (why no bits per weight are given) from a model's histogram of
    number types (map dtypes), its relation, tags, declared bits, total and bytes."""
    has = lambda k: F.map_contains_key("dtypes", k)
    n = lambda k: F.coalesce(F.try_element_at("dtypes", F.lit(k)), F.lit(0))
    sigma = F.aggregate(F.map_values("dtypes"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    tagged = F.exists("tags", lambda t: F.lower(t).rlike(r"^(?:quantized|gguf|awq|gptq|mlx)|^\d+-?bit$"))
    is_quant = (F.coalesce("relation", F.lit("")) == "quantized") | has("U32") | has("F8_E8M0") | tagged | F.col("bits").isNotNull()
    native = (
        F.when(has("F8_E8M0") & has("I8"), F.when(has("F8_E4M3"), "FP4-packed (E8M0 scales) + FP8 (E4M3)").otherwise("FP4-packed (E8M0 scales)"))
        .when(n("F8_E4M3") > sigma - n("F8_E4M3"), "FP8-native (E4M3)")
        .when(has("U32") & has("U8"), "packed payload + E8M0 scales")
        .when(has("U32"), "affine")
        .when(has("U8"), "byte-packed (mxfp-style)")
    )
    bpw = F.col("bytes") * 8 / F.col("total")
    reason = (
        F.when(F.col("total").isNull(), "no parameter count")
        .when(F.coalesce("bytes", F.lit(0)) == 0, "no weights")
        .when((sigma > 0) & has("U32") & (F.col("total") == sigma), "packed storage elements")
        .when(bpw > 2 * F.col("bits"), "more than double the declared width")
    )
    return r.withColumn("is_quant", is_quant).withColumn("native", native).withColumn("reason", reason).withColumn("bpw", F.when(F.col("reason").isNull(), F.round(bpw, 2)))


# fixed values: what extractor messages mean
ERRORS = (
    ("sign in to confirm you|confirm you're not a bot", "bot check"),
    ("private video", "private"),
    ("members-only|members only", "members only"),
    ("age.*restrict|restrict.*age|confirm your age", "age-restricted"),
    ("video unavailable|this video is not available", "unavailable"),
)


def error_kind(message: Column) -> Column:
    out = F.lit("failed")
    for pattern, kind in reversed(ERRORS):
        out = F.when(F.lower(message).rlike(pattern), kind).otherwise(out)
    return F.when(message.isNotNull(), out)
