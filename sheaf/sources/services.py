"""Payloads of services as rows, read with fixed schemas: registries, documents of standards, code hosts,
model hubs, package indexes, forums and video listings. A body that cannot be read gives no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAMES = "array<struct<family:string,given:string,literal:string>>"


def read(payloads: DataFrame, key: str, body: str, schema: str) -> DataFrame:
    """key and the fields of a JSON body; a body that is no object gives no row."""
    return payloads.where(F.try_parse_json(body).isNotNull()).select(key, F.from_json(body, schema).alias("p")).select(key, "p.*")


def person(a: Column) -> Column:
    """Family, Given; what there is of it."""
    return F.coalesce(F.nullif(F.concat_ws(", ", F.nullif(a["family"], F.lit("")), F.nullif(a["given"], F.lit(""))), F.lit("")), a["literal"])


def csl(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """Citation records of a DOI resolver."""
    schema = f"`DOI` string, title string, author {_NAMES}, issued struct<`date-parts`:array<array<int>>>, `container-title` string"
    p = read(payloads, key, body, schema)
    return p.select(key, F.lower("DOI").alias("doi"), "title", F.array_join(F.transform("author", person), "; ").alias("authors"), F.get(F.get(F.col("issued")["date-parts"], F.lit(0)), F.lit(0)).alias("year"), F.col("container-title").alias("venue"))


def registry_record(payloads: DataFrame, key: str, body: str, most: int = 10) -> DataFrame:
    """ORCIDs by name, licence and related identifiers of a data registry. A licence with a standard id comes first,
    else the first with an address; the first ``most`` related identifiers stay."""
    schema = """data struct<attributes:struct<creators:array<struct<name:string,nameIdentifiers:array<struct<nameIdentifier:string,nameIdentifierScheme:string>>>>,
      rightsList:array<struct<rights:string,rightsIdentifier:string,rightsIdentifierScheme:string,rightsUri:string>>,
      relatedIdentifiers:array<struct<relatedIdentifierType:string,relationType:string,relatedIdentifier:string>>,types:struct<resourceTypeGeneral:string>>>"""
    a = read(payloads, key, body, schema).select(key, "data.attributes.*")
    known = F.transform(F.coalesce("creators", F.array()), lambda c: F.struct(c["name"].alias("name"), F.try_element_at(F.filter(F.coalesce(c["nameIdentifiers"], F.array()), lambda i: i["nameIdentifierScheme"] == "ORCID"), F.lit(-1))["nameIdentifier"].alias("orcid")))
    orcids = F.filter(F.transform(known, lambda c: F.struct(c["name"].alias("name"), F.replace(c["orcid"], F.lit("https://orcid.org/"), F.lit("")).alias("orcid"))), lambda c: c["orcid"] != "")
    standard = F.get(F.filter("rightsList", lambda r: r["rightsIdentifierScheme"] == "SPDX"), F.lit(0))
    linked = F.get(F.filter("rightsList", lambda r: r["rightsUri"].isNotNull()), F.lit(0))
    return a.select(
        key,
        F.array_join(F.transform(orcids, lambda c: F.concat(c["name"], F.lit("="), c["orcid"])), "; ").alias("orcids"),
        F.coalesce(standard["rightsIdentifier"], linked["rights"]).alias("licence"),
        F.when(standard.isNotNull(), standard["rightsUri"]).otherwise(linked["rightsUri"]).alias("licence_url"),
        F.array_join(F.transform(F.slice(F.coalesce("relatedIdentifiers", F.array()), 1, most), lambda r: F.concat_ws(" ", r["relationType"], r["relatedIdentifier"])), "; ").alias("related"),
        F.col("types.resourceTypeGeneral").alias("kind"),
    )


def registered_work(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """Type (plain letters only) and citations of a registered work."""
    p = read(payloads, key, body, "message struct<type:string,`is-referenced-by-count`:string,license:array<struct<URL:string,`content-version`:string>>>").where("message IS NOT NULL")
    return p.select(key, F.when(F.octet_length("message.type") == F.length("message.type"), F.col("message.type")).alias("kind"), F.col("message")["is-referenced-by-count"].try_cast("int").alias("citations"), F.coalesce(F.array_size("message.license"), F.lit(0)).alias("licences"))


def references(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """Cited papers, in order, with the contexts that stand on the citation beside them."""
    paper = "paperId:string,title:string,year:int"
    p = read(payloads, key, body, f"data array<struct<contexts:array<string>,citedPaper:struct<{paper}>,{paper}>>, next int")
    r = p.select(key, F.col("next").isNotNull().alias("more"), F.posexplode("data").alias("pos", "r"))
    cited = F.coalesce("r.citedPaper", F.struct("r.paperId", "r.title", "r.year"))
    return r.select(key, "more", "pos", cited.alias("c"), F.coalesce(F.array_size("r.contexts"), F.lit(0)).alias("contexts"), F.get("r.contexts", F.lit(0)).alias("context")).select(key, "more", "pos", "c.*", "contexts", "context")


def standard(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """Metadata of a numbered standard."""
    p = read(payloads, key, body, "doc_id string, title string, authors array<string>, status string, pub_date string, obsoletes array<string>, obsoleted_by array<string>, draft string")
    return p.select(key, F.regexp_replace("doc_id", r"^([A-Z]+)0*", "$1 ").alias("name"), "title", F.array_join("authors", ", ").alias("authors"), F.initcap("status").alias("status"), "pub_date", F.array_join(F.transform("obsoletes", lambda x: F.trim(x)), ", ").alias("obsoletes"), F.array_join(F.transform("obsoleted_by", lambda x: F.trim(x)), ", ").alias("obsoleted_by"))


def standards_found(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """Search results with the total."""
    p = read(payloads, key, body, "meta struct<total_count:bigint>, objects array<struct<name:string,title:string,pages:int>>")
    return p.select(key, F.coalesce("meta.total_count", F.lit(0).cast("bigint")).alias("total"), F.posexplode("objects").alias("pos", "o")).select(key, "total", "pos", "o.*")


def subseries(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """Members of a subseries from its bibliography in XML: an entry of its own, or one for each reference inside."""
    inner = F.xpath(body, F.lit("//reference/@anchor"))
    titles = F.xpath(body, F.lit("//reference/front/title/text()"))
    return payloads.select(key, F.posexplode(F.arrays_zip(inner.alias("a"), titles.alias("t"))).alias("pos", "z")).select(key, "pos", F.col("z.a").alias("member"), F.trim("z.t").alias("title"))


def repository(payloads: DataFrame, key: str, body: str) -> DataFrame:
    p = read(payloads, key, body, "full_name string, description string, stargazers_count bigint, language string, license struct<spdx_id:string>, archived boolean, topics array<string>, pushed_at string")
    return p.select(key, "full_name", "description", F.col("stargazers_count").alias("stars"), "language", F.nullif(F.col("license.spdx_id"), F.lit("NOASSERTION")).alias("licence"), F.coalesce("archived", F.lit(False)).alias("archived"), F.array_join("topics", ", ").alias("topics"), F.left("pushed_at", F.lit(10)).alias("pushed"))


def file_tree(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """Entries of a tree with their folder, and whether it was cut by the host."""
    p = read(payloads, key, body, "truncated boolean, tree array<struct<path:string,type:string,size:bigint>>")
    t = p.select(key, F.coalesce("truncated", F.lit(False)).alias("cut"), F.explode("tree").alias("e")).select(key, "cut", "e.*")
    return t.select(key, "cut", "path", (F.col("type") == "tree").alias("folder"), "size")


def base_model(payloads: DataFrame, key: str, body: str, card: str) -> DataFrame:
    """What a model derives from: its lineage, else what its card's data declare, else the card's own line; ids only."""
    p = payloads.select(key, card, F.try_parse_json(body).alias("v"))
    at = lambda path: F.try_variant_get("v", F.lit(path), "string")
    safe = lambda c: F.when(c.rlike(r"^[A-Za-z0-9][\w.-]{0,95}/[\w.-]{1,96}$"), c)
    line = F.nullif(F.regexp_extract(card, r"(?m)^base_model:[ \t]*[\"']?([^\s\"']+)", 1), F.lit(""))
    ways = [safe(at("$.baseModels.models[0].id")), safe(F.coalesce(at("$.cardData.base_model[0]"), at("$.cardData.base_model"))), safe(line)]
    return p.select(key, F.coalesce(*ways).alias("base"), at("$.baseModels.relation").alias("relation"))


def package_version(payloads: DataFrame, key: str, body: str) -> DataFrame:
    p = read(payloads, key, body, "versionKey struct<name:string,version:string>, licenses array<string>, advisoryKeys array<struct<id:string>>, isDefault boolean, publishedAt string")
    return p.select(key, "versionKey.name", "versionKey.version", F.array_join("licenses", ", ").alias("licences"), F.array_join(F.transform("advisoryKeys", lambda a: a["id"]), ", ").alias("advisories"), F.coalesce("isDefault", F.lit(False)).alias("is_default"), F.left("publishedAt", F.lit(10)).alias("published"))


def dependencies(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """Nodes of a dependency graph with what asks for them; the last edge to a node counts."""
    p = read(payloads, key, body, "nodes array<struct<versionKey:struct<name:string,version:string>,relation:string>>, edges array<struct<fromNode:int,toNode:int,requirement:string>>")
    nodes = p.select(key, F.posexplode("nodes").alias("n", "v"), "edges")
    asked = F.try_element_at(F.filter("edges", lambda e: e["toNode"] == F.col("n")), F.lit(-1))
    return nodes.where("v.relation <> 'SELF'").select(key, "n", "v.versionKey.name", "v.versionKey.version", "v.relation", asked["requirement"].alias("requirement"))


def project(payloads: DataFrame, key: str, body: str) -> DataFrame:
    p = read(payloads, key, body, "projectKey struct<id:string>, starsCount bigint, forksCount bigint, license string, scorecard struct<overallScore:double,checks:array<struct<name:string,score:int>>>")
    return p.select(key, F.col("projectKey.id").alias("project"), F.col("starsCount").alias("stars"), F.col("forksCount").alias("forks"), "license", F.col("scorecard.overallScore").alias("score"), F.array_join(F.transform(F.filter("scorecard.checks", lambda c: c["score"].between(0, 5)), lambda c: c["name"]), ", ").alias("weak"))


def advisory(payloads: DataFrame, key: str, body: str) -> DataFrame:
    p = read(payloads, key, body, "advisoryKey struct<id:string>, title string, aliases array<string>, cvss3Score double, url string")
    return p.select(key, F.col("advisoryKey.id").alias("id"), "title", F.array_join(F.filter("aliases", lambda a: a.startswith("CVE-")), ", ").alias("aliases"), F.col("cvss3Score").alias("score"), "url")


# fixed values: why a community cannot be read
_REASONS = {"quarantined": "Error: This subreddit is quarantined.", "gated": "Error: This subreddit is gated (age or community restricted).", "private": "Error: This subreddit is private.", "banned": "Error: This subreddit is banned."}


def community_error(body: Column) -> Column:
    """The error that a community's answer is, null for a real one."""
    v = F.try_parse_json(body)
    at = lambda path, kind="string": F.try_variant_get(v, F.lit(path), kind)
    code = at("$.error", "int")
    reason = F.try_element_at(F.create_map(*[F.lit(x) for kv in _REASONS.items() for x in kv]), at("$.reason"))
    said = F.rtrim(F.concat(F.lit("Error: Reddit API error "), code.cast("string"), F.lit(": "), F.coalesce(at("$.message"), F.lit(""))))
    return F.when(at("$.data.is_suspended", "boolean"), "Error: This Reddit account is suspended.").when(code.isNotNull(), F.coalesce(reason, F.when(at("$.message") == "Unauthorized", "Error: Reddit returned Unauthorized."), said))


def community_listing(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """Children of a listing with their kind, and the cursor to the next page."""
    p = read(payloads, key, body, "data struct<after:string,children:array<struct<kind:string,data:struct<id:string,title:string,body:string,author:string,score:bigint,num_comments:bigint>>>>")
    return p.select(key, F.col("data.after").alias("after"), F.posexplode("data.children").alias("pos", "c")).select(key, "after", "pos", "c.kind", "c.data.*")


def forum_search(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """Posts found, with the topic each belongs to; a topic that is missing leaves its fields empty."""
    p = read(payloads, key, body, "posts array<struct<id:bigint,topic_id:bigint,username:string,blurb:string>>, topics array<struct<id:bigint,title:string,posts_count:bigint>>")
    r = p.select(key, F.posexplode("posts").alias("pos", "r"), "topics")
    topic = F.get(F.filter("topics", lambda t: t["id"] == F.col("r.topic_id")), F.lit(0))
    return r.select(key, "pos", "r.username", "r.blurb", F.coalesce(topic["title"], F.lit("Untitled")).alias("title"), F.coalesce(topic["posts_count"], F.lit(0)).alias("posts"))


def video_listing(payloads: DataFrame, key: str, body: str, most: int = 50) -> DataFrame:
    """Entries of a channel, playlist or search, the first ``most``."""
    p = read(payloads, key, body, "title string, channel_id string, playlist_count bigint, entries array<struct<id:string,title:string,duration:double,view_count:bigint>>")
    return p.select(key, F.col("title").alias("listing"), "channel_id", F.col("playlist_count").alias("total"), F.posexplode_outer(F.slice(F.coalesce("entries", F.array()), 1, most)).alias("pos", "e")).select(key, "listing", "channel_id", "total", "pos", "e.*")


def video_comments(payloads: DataFrame, key: str, body: str) -> DataFrame:
    p = read(payloads, key, body, "comments array<struct<id:string,parent:string,author:string,text:string,like_count:bigint>>")
    return p.select(key, F.posexplode("comments").alias("pos", "c")).select(key, "pos", "c.*")


def web_results(payloads: DataFrame, key: str, body: str, after: str | None = None, before: str | None = None) -> DataFrame:
    """Results of a web search between two days, in rank order; results without a day stay only without bounds."""
    p = read(payloads, key, body, "data array<struct<t:int,rank:int,url:string,title:string,snippet:string,published:string>>")
    r = p.select(key, F.explode("data").alias("r")).select(key, "r.*").where("t = 0")
    day = F.left("published", F.lit(10))
    if after:
        r = r.where(day >= after)
    if before:
        r = r.where(day <= before)
    return r.select(key, "rank", "url", "title", day.alias("day"))


def wiki_page(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """Title and HTML of a parsed page."""
    p = read(payloads, key, body, "parse struct<displaytitle:string,pageid:bigint,text:map<string,string>>").where("parse IS NOT NULL")
    return p.select(key, "parse.pageid", F.trim(F.regexp_replace("parse.displaytitle", "<[^>]+>", "")).alias("title"), F.try_element_at("parse.text", F.lit("*")).alias("html"))
