"""URL classification as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_group(value: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without a match or with an empty group."""
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once: long classifications otherwise repeat
    its expression at every mention, until generated code grows beyond its limit."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def arxiv_id(url: Column) -> Column:
    """Paper id of an abstract or PDF page; HTML pages are read as documents."""
    return first_group(url, r"(?i)https?://(?:export\.)?arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5}(?:v\d+)?)")


def arxiv_html_id(url: Column) -> Column:
    return first_group(url, r"(?i)https?://(?:export\.)?arxiv\.org/html/(\d{4}\.\d{4,5}(?:v\d+)?)")


def without_version(paper: Column) -> Column:
    """DOIs are registered without a version."""
    return F.regexp_replace(paper, r"v\d+$", "")


def doi(url: Column) -> Column:
    return first_group(url, r"(?i)https?://(?:dx\.)?doi\.org/(10\.\S+)")


def paper_hash(url: Column) -> Column:
    return first_group(url, r"(?i)https?://(?:www\.)?semanticscholar\.org/paper/(?:[^/]+/)?([0-9a-f]{40})")


def rfc_number(url: Column) -> Column:
    editor = first_group(url, r"(?i)https?://www\.rfc-editor\.org/rfc/rfc(\d+)(?:\.json)?(?:[/?#]|$)")
    tracker = first_group(url, r"(?i)https?://datatracker\.ietf\.org/doc/rfc(\d+)")
    return F.coalesce(editor, tracker).cast("bigint")


def draft_name(url: Column) -> Column:
    return F.when(rfc_number(url).isNull(), first_group(url, r"(?i)https?://datatracker\.ietf\.org/doc/(draft-[\w.-]+)"))


def _path(url: Column) -> Column:
    """Path without query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")


def reddit_kind(url: Column) -> Column:
    path = _path(url)
    short = url.rlike(r"^(?i)https?://redd\.it/\w+")
    site = url.rlike(r"^(?i)https?://(?:(?:www|old|new|np)\.)?reddit\.com/")
    return F.when(short, "short_link").when(
        site,
        F.when(path.rlike(r"(?i)/(?:r/[^/]+/)?comments/\w+"), "comment_thread").when(path.rlike(r"(?i)/search/?$"), "search").when(path.rlike(r"(?i)/(?:u|user)/[^/]+"), "user").otherwise("subreddit"),
    )


def reddit_canonical(url: Column) -> Column:
    """Listing and permalink URLs on the old host, keeping only the sort order."""
    path = F.regexp_replace(_path(url), r"\.json$", "")
    path = F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))
    sort = first_group(url, r"[?&]sort=([^&#]+)")
    plain = F.concat(F.lit("https://old.reddit.com"), path, F.when(sort.isNotNull(), F.concat(F.lit("?sort="), sort)).otherwise(F.lit("")))
    return F.when(reddit_kind(url).isNull(), None).when(reddit_kind(url) == "short_link", url).when(reddit_kind(url) != "search", plain)


def reddit_comment(url: Column) -> Column:
    """Id of the comment a permalink points at."""
    return first_group(_path(url), r"(?i)^/r/[^/]+/comments/\w+/[^/]+/(\w+)/?$")


# fixed values: first path segments of the model hub that are no organisations
HUB_RESERVED = ("models", "docs", "blog", "learn", "papers", "collections", "posts", "login", "join", "settings", "pricing", "notifications", "new", "organizations", "chat", "tasks", "inference", "api", "search", "welcome", "enterprise", "changelog", "terms-of-service", "privacy", "content-guidelines", "code-of-conduct", "brand")


def hub_match(url: Column) -> Column:
    """Struct kind, repo, rev, path of a model hub URL; null for others."""
    trimmed = F.trim(url)
    seg = F.filter(F.split(_path(trimmed), "/"), lambda s: s != "")
    head, rest = F.lower(seg[0]), F.array_join(F.slice(seg, 3, 50), "/")
    n = F.size(seg)
    repo = F.concat_ws("/", F.get(seg, F.lit(0)), F.get(seg, F.lit(1)))
    tree = rest.rlike(r"^tree/[^/]+")
    file = rest.rlike(r"^(?:blob|resolve|raw)/[^/]+/.+")
    special = head.isin("datasets", "spaces")
    kind = (
        F.when(special, F.when(n >= 2, F.when(head == "datasets", "dataset").otherwise("space")))
        .when(head.isin(*HUB_RESERVED), None)
        .when(n == 1, "org")
        .when(rest.rlike(r"^(?i)commit/[0-9a-f]{7,40}$"), "commit")
        .when(tree, "tree")
        .when(file, "file")
        .otherwise("model")
    )
    is_host = trimmed.rlike(r"^(?i)https?://(?:www\.)?huggingface\.co(?:/.*)?$") & (n > 0)
    out = F.struct(
        kind.alias("kind"),
        F.when(special, F.array_join(F.slice(seg, 2, 2), "/")).when(n >= 2, repo).otherwise("").alias("repo"),
        F.when(tree | file, F.regexp_extract(rest, r"^[a-z]+/([^/]+)", 1)).otherwise("main").alias("rev"),
        F.when((tree | file) & ~special, F.regexp_replace(rest, r"^[a-z]+/[^/]+/?", "")).alias("path"),
    )
    return F.when(is_host & kind.isNotNull(), out)


# fixed values: first path segments of the code host that are no owners
CODE_RESERVED = ("settings", "orgs", "marketplace", "explore", "topics", "trending", "collections", "sponsors", "features", "security", "enterprise", "pricing", "login", "signup", "join", "new")


def code_match(url: Column, signed_in: bool = False) -> Column:
    """Struct kind, owner, repo, number, ref, path of a code host URL; null for others."""
    at = r"(?i)^https?://(?:www\.)?github\.com/"
    path = F.regexp_replace(F.regexp_replace(url, at, ""), r"[?#].*$|/+$", "")
    path = F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"^([^/]+/[^/]+?)\.git(/|$)", "$1$2")
    return bound(F.struct(url.alias("u"), F.split(path, "/").alias("seg")), lambda b: _code_match(b["u"], b["seg"], signed_in))


def _code_match(url: Column, seg: Column, signed_in: bool) -> Column:
    at = r"(?i)^https?://(?:www\.)?github\.com/"
    raw = r"(?i)^https?://raw\.githubusercontent\.com/([^/]+)/([^/]+)/([^/]+)/([^?#]+)"
    owner, repo, what = F.get(seg, F.lit(0)), F.get(seg, F.lit(1)), F.get(seg, F.lit(2))
    arg, tail = F.get(seg, F.lit(3)), F.nullif(F.array_join(F.slice(seg, 5, 100), "/"), F.lit(""))
    number = F.when(what.isin("issues", "pull", "discussions"), F.regexp_extract(arg, r"^(\d+)$", 1))
    has_number = F.coalesce(F.length(number), F.lit(0)) > 0
    kinds = (
        F.when(F.size(seg) == 2, "repo")
        .when((what == "blob") & tail.isNotNull(), "blob")
        .when((what == "tree") & arg.isNotNull(), "tree")
        .when((what == "issues") & has_number, "issue")
        .when((what == "pull") & has_number, "pull")
        .when((what == "discussions") & has_number & F.lit(signed_in), "discussion")
        .when(what == "wiki", "wiki")
        .when((what == "commit") & arg.rlike("^[0-9a-fA-F]+$"), "commit")
        .when((what == "compare") & arg.isNotNull(), "compare")
        .when((what == "blame") & tail.isNotNull(), "blame")
        .when(what == "releases", "releases")
        .when(what.isin("actions", "projects"), what)
    )
    is_code = url.rlike(at + r"[^/?#]+")
    org = is_code & (F.size(seg) == 1) & ~F.lower(owner).isin(*CODE_RESERVED, "about", "readme", "codespaces", "copilot", "issues", "pulls", "discussions", "notifications")
    gist = first_group(url, r"(?i)^https?://gist\.github\.com/(?:[^/]+/)?([0-9a-f]+)")
    empty = F.lit(None).cast("string")
    fields = lambda kind, o, r, n, ref, p: F.struct(kind.alias("kind"), o.alias("owner"), r.alias("repo"), n.cast("bigint").alias("number"), ref.alias("ref"), p.alias("path"))
    ref = F.when(kinds.isin("blob", "tree", "blame", "commit"), arg)
    where = F.when(kinds.isin("blob", "tree", "blame"), tail).when(kinds.isin("wiki", "compare", "releases"), F.nullif(F.array_join(F.slice(seg, 4, 100), "/"), F.lit("")))
    return (
        F.when(url.rlike(raw), fields(F.lit("blob"), F.regexp_extract(url, raw, 1), F.regexp_extract(url, raw, 2), empty, F.regexp_extract(url, raw, 3), F.regexp_extract(url, raw, 4)))
        .when(gist.isNotNull(), fields(F.lit("gist"), empty, empty, empty, empty, gist))
        .when(org, fields(F.lit("org"), owner, empty, empty, empty, empty))
        .when(is_code & ~owner.isin(*CODE_RESERVED) & kinds.isNotNull(), fields(kinds, owner, repo, F.when(has_number, number), ref, where))
    )


def video_match(url: Column) -> Column:
    """Struct kind, id of a video site URL; the music host is told apart first."""
    host = r"https?://(?:www\.|m\.)?youtube\.com/"
    video = F.coalesce(
        first_group(url, rf"(?i){host}(?:watch\?(?:[^#]*&)?v=|shorts/|embed/|v/)([A-Za-z0-9_-]{{11}})"),
        first_group(url, r"(?i)https?://youtu\.be/([A-Za-z0-9_-]{11})"),
        first_group(url, rf"(?i){host}clip/([A-Za-z0-9_-]+)"),
    )
    handle = first_group(url, rf"(?i){host}(@[A-Za-z0-9._-]+)")
    channel = first_group(url, rf"(?i){host}(?:channel/(?=UC[A-Za-z0-9_-]{{22}})|c/|user/)([A-Za-z0-9._-]+)")
    playlist = first_group(url, rf"(?i){host}playlist\?(?:[^#]*&)?list=([A-Za-z0-9_-]+)")
    pick = lambda kind, ident: F.struct(F.lit(kind).alias("kind"), ident.alias("id"))
    return (
        F.when(url.rlike(r"(?i)https?://music\.youtube\.com/"), pick("music", url))
        .when(video.isNotNull(), pick("video", video))
        .when(handle.isNotNull(), pick("channel", handle))
        .when(channel.isNotNull(), pick("channel", channel))
        .when(playlist.isNotNull(), pick("playlist", playlist))
    )


_TOPIC = r"/t/(?:[^/]*/)?(\d+)(?:/\d+)?/?$"


def topic_id(url: Column) -> Column:
    return first_group(_path(url), _TOPIC).cast("bigint")


def forum_base(url: Column) -> Column:
    """Root of the forum that serves a URL; path prefixes stay, query and fragment go."""
    base = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), _TOPIC, "")
    return F.regexp_replace(base, r"/+$", "")


def scheme_allowed(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https"), F.lit(False))


def fragment(url: Column) -> Column:
    return F.nullif(F.when(F.instr(url, "#") > 0, F.regexp_replace(url, r"^[^#]*#", "")), F.lit(""))


def route(url: Column) -> Column:
    """Which source answers a URL; the first that claims it."""
    return (
        F.when(arxiv_id(url).isNotNull(), "arxiv")
        .when(paper_hash(url).isNotNull(), "paper")
        .when(rfc_number(url).isNotNull() | draft_name(url).isNotNull(), "ietf")
        .when(doi(url).isNotNull(), "doi")
        .when(reddit_kind(url).isNotNull(), "reddit")
        .when(code_match(url).isNotNull(), "code")
        .when(hub_match(url).isNotNull(), "hub")
        .when(video_match(url).isNotNull(), "video")
        .when(topic_id(url).isNotNull(), "forum")
        .otherwise("generic")
    )


def percent_encoded(value: Column) -> Column:
    """All but letters, digits and -_.~ percent-encoded, a blank as %20."""
    return F.replace(F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))


def wiki_title(title: Column) -> Column:
    """Underscores for blanks, first letter in upper case."""
    t = F.replace(F.trim(title), F.lit(" "), F.lit("_"))
    return F.concat(F.upper(F.left(t, F.lit(1))), F.substring(t, 2, 10_000))
