"""Scalar text functions: headings, slugs, formats, dates, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_spaces(text: Column) -> Column:
    """Exotic white space and zero-width marks become a blank."""
    return F.regexp_replace(text, r"[\x{00A0}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}\x{FEFF}]", " ")


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def without_number(name: Column) -> Column:
    """A section name without its leading number, as in 13.2.6 or 15."""
    return F.regexp_replace(name, r"^\d+(?:\.\d+)*(?:\\?\.)?\s+", "")


def heading_text(text: Column) -> Column:
    """A heading without images, links, emphasis and code marks."""
    t = F.regexp_replace(text, r"!\[([^\]]*)\]\((?:\\[()]|[^()])*\)", "$1")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\((?:\\[()]|[^()])*\)", "$1")
    t = F.regexp_replace(t, r"\*\*([^*]+)\*\*", "$1")
    t = F.regexp_replace(t, r"(?<!\*)\*([^*\n]+)\*(?!\*)", "$1")
    return F.trim(F.regexp_replace(t, r"`([^`]+)`", "$1"))


def clean_forum_post(raw: Column) -> Column:
    """Quotes as block quotes, uploads as [image], no contents box, no image sizes."""
    t = F.regexp_replace(raw, r"<div\b[^>]*\bdata-theme-toc\b[^>]*>(?:(?!</div>)[\s\S])*</div>", "")
    t = F.regexp_replace(t, r"\[quote=\"([^,\"\]]+)(?:,[^\"\]]*?)?,\s*post:(\d+)[^\"\]]*\"\]\s*", "> **@$1** (post #$2):\n> ")
    t = F.regexp_replace(t, r"\[quote=\"([^,\"\]]+)[^\"\]]*\"\]\s*", "> **@$1**:\n> ")
    # fixed values: the forum's closing mark and its size hints
    t = F.regexp_replace(t, r"(?i)\[/quote\]\s*", "\n")
    t = F.regexp_replace(t, r"!\[[^\]]*\]\(upload://[^)]*\)", "[image]")
    t = F.regexp_replace(t, r"\|(\d+x\d+|\d+)(, \d+%)?(?=\])", "")
    return F.trim(t)


def without_card_header(card: Column) -> Column:
    """A model card without the YAML block at its start."""
    return F.regexp_replace(card, r"^(?s)---\n.*?\n---\n", "")


def content_class(content_type: Column) -> Column:
    """html, json, xml or plain text, in this order; null for what is not read."""
    t = content_type
    return F.when(t.rlike("text/html|application/xhtml"), "html").when(t.rlike("(?:application|text)/json"), "json").when(t.rlike("(?:application|text)/xml"), "xml").when(t.contains("text/plain"), "plain text")


def clock(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on."""
    s = seconds.cast("bigint")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m, sec = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return F.when(h > 0, F.concat_ws(":", F.when(h < 100, two(h)).otherwise(h.cast("string")), two(m), two(sec))).when(s.isNotNull(), F.concat_ws(":", two(m), two(sec)))


def duration(seconds: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on."""
    s = seconds.cast("bigint")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m, sec = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(sec))).when(s.isNotNull(), F.concat_ws(":", m.cast("string"), two(sec)))


def upload_date(day: Column) -> Column:
    """YYYYMMDD with dashes; anything else as it is."""
    return F.when(day.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2))).otherwise(day)


def partial_date(parts: Column) -> Column:
    """YYYY[-MM[-DD]] of an array of one to three numbers."""
    return F.when(F.size(parts) >= 3, F.format_string("%04d-%02d-%02d", parts[0], parts[1], F.get(parts, F.lit(2)))).when(F.size(parts) == 2, F.format_string("%04d-%02d", parts[0], F.get(parts, F.lit(1)))).when(F.size(parts) == 1, F.format_string("%04d", parts[0]))


def relative_age(at: Column, now: Column) -> Column:
    """just now, then minutes, hours, days, months, years ago."""
    s = F.unix_timestamp(now) - F.unix_timestamp(at)
    text = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit))
    return F.when(s < 60, "just now").when(s < 3600, text(s / 60, "m ago")).when(s < 86400, text(s / 3600, "h ago")).when(s < 86400 * 30, text(s / 86400, "d ago")).when(s < 86400 * 365, text(s / (86400 * 30), "mo ago")).otherwise(text(s / (86400 * 365), "y ago"))


def elapsed(at: Column, since: Column) -> Column:
    """T+HH:MM:SS, never before the start."""
    s = F.greatest(F.unix_timestamp(at) - F.unix_timestamp(since), F.lit(0))
    two = lambda c: F.when(c < 100, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))
    return F.concat(F.lit("T+"), F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor((s % 3600) / 60)), two(s % 60)))


def severity(score: Column) -> Column:
    """Band of a vulnerability score."""
    return F.when(score >= 9, "Critical").when(score >= 7, "High").when(score >= 4, "Medium").when(score > 0, "Low").when(score.isNotNull(), "None")


def doi_rank(doi: Column) -> Column:
    """Publisher 2, biological preprint server 1, preprint server 0."""
    return F.when(doi.startswith("10.48550/arXiv."), 0).when(doi.startswith("10.1101/"), 1).when(doi.isNotNull(), 2)


def human_bytes(n: Column) -> Column:
    """GiB with two places, MiB with one, else bytes; null for none."""
    v = n.cast("double")
    return F.when(v >= 1024**3, F.format_string("%.2f GiB", F.bround(v / 1024**3, 2))).when(v >= 1024**2, F.format_string("%.1f MiB", F.bround(v / 1024**2, 1))).when(v > 0, F.concat(F.format_number(n, 0), F.lit(" B")))


def human_count(n: Column) -> Column:
    """Billions and millions with one place, else the number; null for none."""
    v = n.cast("double")
    return F.when(v >= 1e9, F.format_string("%.1fB", F.bround(v / 1e9, 1))).when(v >= 1e6, F.format_string("%.1fM", F.bround(v / 1e6, 1))).when(v > 0, F.format_number(n, 0))


def log_bytes(n: Column) -> Column:
    v = n.cast("double")
    return F.when(v < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B"))).when(v < 1024**2, F.format_string("%.1f KB", F.bround(v / 1024, 1))).otherwise(F.format_string("%.1f MB", F.bround(v / 1024**2, 1)))


def repo_number(query: Column) -> Column:
    """Struct owner, repo, number of owner/repo#n."""
    p = r"^([^/\s]+)/([^/#\s]+)#(\d+)$"
    return F.when(query.rlike(p), F.struct(F.regexp_extract(query, p, 1).alias("owner"), F.regexp_extract(query, p, 2).alias("repo"), F.regexp_extract(query, p, 3).cast("bigint").alias("number")))


# fixed values: package ecosystems by the names people use
ECOSYSTEMS = {"pypi": "PYPI", "npm": "NPM", "cargo": "CARGO", "crates": "CARGO", "go": "GO", "golang": "GO", "maven": "MAVEN", "nuget": "NUGET", "rubygems": "RUBYGEMS", "gems": "RUBYGEMS"}


def package_query(query: Column) -> Column:
    """Struct system, name, version of ecosystem/name[@version]; a scoped name keeps its first @."""
    eco = F.lower(F.regexp_extract(query, r"^([^/]+)/", 1))
    rest = F.regexp_replace(query, r"^[^/]+/", "")
    versioned = r"^(.+)@([^@]*)$"
    systems = F.create_map(*[F.lit(x) for kv in ECOSYSTEMS.items() for x in kv])
    return F.struct(
        F.try_element_at(systems, eco).alias("system"),
        F.when(rest.rlike(versioned), F.regexp_extract(rest, versioned, 1)).otherwise(rest).alias("name"),
        F.when(rest.rlike(versioned), F.nullif(F.regexp_extract(rest, versioned, 2), F.lit(""))).alias("version"),
    )


def repo_rev(query: Column) -> Column:
    """Struct repo, rev of repo[@rev]; the revision defaults to main."""
    return F.struct(F.split_part(query, F.lit("@"), F.lit(1)).alias("repo"), F.coalesce(F.nullif(F.split_part(query, F.lit("@"), F.lit(2)), F.lit("")), F.lit("main")).alias("rev"))


# fixed values: marks that conversions append to a model's name
CONVERSIONS = r"\d+bit|\d+-bit|q\d+(?:_[kms0-9]+)*|oq\d+|gguf|mlx|awq|gptq|exl\d*|fp\d+|int\d+|bf16|f16|mxfp\d+|hf|lm|instruct-\d+bit"


def family_stem(repo: Column) -> Column:
    """A model's name without the marks of its conversions, however many; never empty."""
    name = F.element_at(F.split(repo, "/"), -1)
    return F.regexp_replace(name, rf"(?i)(?<=.)(?:[-_.](?:{CONVERSIONS}))+$", "")


def bold_snippet(html: Column) -> Column:
    """Search marks of a snippet as bold text, other tags gone, entities resolved."""
    t = F.regexp_replace(html, r"<span class=\"searchmatch\">([^<]*)</span>", "**$1**")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for entity, char in (("&quot;", '"'), ("&#039;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


def fenced(content: Column, title: Column) -> Column:
    """Content between box marks, every line after a bar; the title as a heading inside."""
    body = F.array_join(F.transform(F.split(content, "\n"), lambda x: F.concat(F.lit("│ "), x)), "\n")
    head = F.when(title.isNotNull(), F.concat(F.lit("│ # "), title, F.lit("\n│ \n"))).otherwise(F.lit(""))
    return F.concat(F.lit("┌─ untrusted content\n│\n"), head, body, F.lit("\n│\n└─ untrusted content"))


def label(text: Column) -> Column:
    """A label without control and other characters that do not print."""
    return F.regexp_replace(text, r"\p{C}", " ")


def charset(content_type: Column) -> Column:
    """Charset of a content type in lower case; UTF-8 without one."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(content_type, r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", 1)), F.lit("")), F.lit("utf-8"))


def decoded(content: Column, content_type: Column) -> Column:
    """Text of a body in its charset; charsets that are not built in are read as UTF-8."""
    c = charset(content_type)
    read = lambda name: F.try_validate_utf8(content.cast("string")) if name == "utf-8" else F.decode(content, name)
    return F.when(c.isin("iso-8859-1", "latin-1", "windows-1252"), read("ISO-8859-1")).when(c == "utf-16", read("UTF-16")).when(c == "us-ascii", read("US-ASCII")).otherwise(read("utf-8"))
