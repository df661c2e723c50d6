"""API payloads as rows: JSON and XML bodies read with fixed schemas. A body that cannot be read gives no row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import bold_snippet


def timed_text(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """(key, pos, start, duration, text) of a timed-text feed: fragments joined, blank cues dropped."""
    schema = "events array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>"
    e = payloads.select(key, F.posexplode(F.from_json(body, schema)["events"]).alias("pos", "e"))
    text = F.trim(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    ms = lambda c: F.coalesce(c, F.lit(0)) / 1000.0
    return e.select(key, "pos", ms(F.col("e.tStartMs")).alias("start"), ms(F.col("e.dDurationMs")).alias("duration"), text.alias("text")).where("text <> ''")


def wiki_search(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """(key, total, pos, title, pageid, snippet); a missing total stays null."""
    schema = "query struct<searchinfo:struct<totalhits:bigint>,search:array<struct<title:string,pageid:bigint,snippet:string>>>"
    q = payloads.select(key, F.from_json(body, schema)["query"].alias("q")).select(key, F.col("q.searchinfo.totalhits").alias("total"), F.posexplode("q.search").alias("pos", "r"))
    return q.select(key, "total", "pos", "r.title", "r.pageid", F.trim(bold_snippet(F.col("r.snippet"))).alias("snippet"))


def papers(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """Paper search results, only the fields that are used."""
    schema = "total bigint, offset bigint, data array<struct<paperId:string,title:string,year:int,authors:array<struct<name:string>>,citationCount:bigint>>"
    p = payloads.select(key, F.from_json(body, schema).alias("p")).select(key, "p.total", F.posexplode("p.data").alias("pos", "r"))
    return p.select(key, "total", "pos", "r.paperId", "r.title", "r.year", F.array_join(F.transform("r.authors", lambda a: a["name"]), ", ").alias("authors"), "r.citationCount")


def atom_entries(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """Entries of an Atom feed."""
    x = payloads.select(key, F.posexplode(F.xpath(body, F.lit("//*[local-name()='entry']/*[local-name()='id']/text()"))).alias("pos", "id"), body)
    at = lambda what: F.get(F.xpath(body, F.lit(f"//*[local-name()='entry']/*[local-name()='{what}']/text()")), F.col("pos"))
    return x.select(key, "pos", "id", F.trim(F.regexp_replace(at("title"), r"\s+", " ")).alias("title"), at("published").alias("published"))


def package_versions(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """(key, package, version, published, is_default, deprecated)."""
    schema = "packageKey struct<system:string,name:string>, versions array<struct<versionKey:struct<version:string>,publishedAt:string,isDefault:boolean,isDeprecated:boolean>>"
    p = payloads.select(key, F.from_json(body, schema).alias("p")).select(key, F.col("p.packageKey.name").alias("package"), F.explode("p.versions").alias("v"))
    return p.select(key, "package", F.col("v.versionKey.version").alias("version"), F.try_to_timestamp("v.publishedAt").alias("published"), F.coalesce("v.isDefault", F.lit(False)).alias("is_default"), F.coalesce("v.isDeprecated", F.lit(False)).alias("deprecated"))


def forum_topic(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """Posts of a topic with what they answer."""
    schema = "title string, post_stream struct<stream:array<bigint>,posts:array<struct<id:bigint,post_number:bigint,username:string,raw:string,created_at:string,reply_to_post_number:bigint>>>"
    p = payloads.select(key, F.from_json(body, schema).alias("p")).select(key, "p.title", F.explode("p.post_stream.posts").alias("r"))
    return p.select(key, "title", "r.*")


def model_config(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """Dimensions of a model from its config: the block with more known keys of the flat and the text one,
    with the ways experts are spelled. Numbers only; true and false are none."""
    v = payloads.select(key, F.try_parse_json(body).alias("v"))
    known = ("hidden_size", "num_hidden_layers", "num_attention_heads", "num_key_value_heads", "vocab_size")
    n = lambda p: F.try_variant_get("v", F.lit(p), "bigint")
    number = lambda p: F.when(F.schema_of_variant(F.try_variant_get("v", F.lit(p), "variant")).isin("BIGINT", "INT"), n(p))
    count = lambda at: sum((F.when(number(f"{at}.{k}").isNotNull(), 1).otherwise(0) for k in known), F.lit(0))
    nested = count("$.text_config") > count("$")
    pick = lambda k: F.when(nested, number(f"$.text_config.{k}")).otherwise(number(f"$.{k}"))
    experts = F.coalesce(*[pick(k) for k in ("num_experts", "num_local_experts", "n_routed_experts")])
    return v.select(key, *[pick(k).alias(k) for k in known], experts.alias("experts"), F.try_variant_get("v", F.lit("$.torch_dtype"), "string").alias("dtype"))
