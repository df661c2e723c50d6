"""HTML to Markdown in one pass over a page's tokens, and checks on raw HTML."""

from __future__ import annotations

import html as entities
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what is dropped, and the roots that scripts fill
NOISE = frozenset("script style nav header footer aside noscript head template svg".split())
ROOTS = ("root", "app", "__next", "__nuxt", "__svelte", "__gatsby")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Writer(HTMLParser):
    def __init__(self, links: bool):
        super().__init__(convert_charrefs=True)
        self.links = links
        self.out: list[str] = []
        self.skip: list[str] = []
        self.lists: list[list] = []
        self.pre = self.heading = 0
        self.href: list[tuple[str | None, int]] = []
        self.row: list[str] | None = None
        self.rows = 0
        self.title = ""
        self.og = ""
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and a.get("property") == "og:title":
            self.og = self.og or (a.get("content") or "")
        if tag == "title":
            self.in_title = True
        if self.skip or tag in NOISE:
            if tag not in _VOID:
                self.skip.append(tag)
            return
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.block()
            self.out.append("#" * int(tag[1]) + " ")
            self.heading += 1
        elif tag in ("p", "div", "section", "article", "main", "figure", "dl", "form") and not self.heading and not self._in_item():
            self.block()
        elif tag in ("ul", "ol"):
            if not self.lists:
                self.block()
            self.lists.append([tag, 0])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.line()
            self.out.append("    " * max(0, len(self.lists) - 1) + ("*   " if kind[0] == "ul" else f"{kind[1]}.  "))
        elif tag == "br":
            self.out.append(" " if self.heading else "\n")
        elif tag == "hr":
            self.block()
            self.out.append("---\n\n")
        elif tag == "pre":
            self.block()
            self.out.append("```\n")
            self.pre += 1
        elif tag == "code" and not self.pre and not self.heading:
            self.out.append("`")
        elif tag in ("b", "strong") and not self.heading:
            self.out.append("**")
        elif tag in ("i", "em") and not self.heading:
            self.out.append("*")
        elif tag == "blockquote":
            self.block()
            self.out.append("> ")
        elif tag == "img":
            alt = (a.get("alt") or "").strip()
            if alt and not self.heading:
                self.out.append(f"[Image: {alt}]")
        elif tag == "a":
            self.href.append((a.get("href"), len(self.out)))
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            self.cell = len(self.out)
        elif tag == "table":
            self.block()
            self.rows = 0

    def handle_startendtag(self, tag, attrs):
        if tag in _VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if self.skip:
            if tag in self.skip:
                while self.skip and self.skip.pop() != tag:
                    pass
            return
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.heading = max(0, self.heading - 1)
            self.block()
        elif tag in ("p", "div", "section", "article", "main", "blockquote", "figure", "table") and not self.heading and not self._in_item():
            self.block()
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            if not self.lists:
                self.block()
        elif tag == "pre" and self.pre:
            self.pre -= 1
            if self.out and not self.out[-1].endswith("\n"):
                self.out.append("\n")
            self.out.append("```\n\n")
        elif tag == "code" and not self.pre and not self.heading:
            self.out.append("`")
        elif tag in ("b", "strong") and not self.heading:
            self.out.append("**")
        elif tag in ("i", "em") and not self.heading:
            self.out.append("*")
        elif tag == "a" and self.href:
            href, at = self.href.pop()
            text = "".join(self.out[at:])
            if self.links and href and not self.heading and text.strip() and not re.fullmatch(r"\s*\[Image: [^\]]*\]\s*", text):
                self.out[at:] = [f"[{text.strip()}]({href})"]
        elif tag in ("td", "th") and self.row is not None:
            at = getattr(self, "cell", len(self.out))
            self.row.append(re.sub(r"\s+", " ", "".join(self.out[at:])).strip())
            del self.out[at:]
        elif tag == "tr" and self.row is not None:
            if self.row:
                self.line()
                self.out.append("| " + " | ".join(self.row) + " |\n")
                self.rows += 1
                if self.rows == 1:
                    self.out.append("|" + " --- |" * len(self.row) + "\n")
            self.row = None

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if self.skip or self.in_title:
            return
        if self.pre:
            self.out.append(data)
            return
        text = re.sub(r"\s+", " ", data)
        if text == " " and (not self.out or self.out[-1].endswith(("\n", " "))):
            return
        if self.out and self.out[-1].endswith("\n"):
            text = text.lstrip()
        if text:
            self.out.append(text)

    def _in_item(self) -> bool:
        return bool(self.lists)

    def line(self):
        if self.out and not self.out[-1].endswith("\n"):
            self.out.append("\n")

    def block(self):
        if self.out:
            tail = "".join(self.out[-2:])
            if not tail.endswith("\n\n"):
                self.out.append("\n" if tail.endswith("\n") else "\n\n")


_ITEM_HEADING = re.compile(r"^([ \t]*(?:[-*+]|\d+[.)])[ \t]+)(#{1,6}[ \t]+\S.*)((?:\n[ \t]*$|\n[ \t]+\S.*$)*)", re.M)


def promote_list_headings(markdown: str) -> str:
    """Headings inside list items come out of the list; the item's body loses the marker's width.

    An item is matched with the indented lines below it; code at the margin stays as it is.
    """
    from sheaf.operators.structure import fenced_ranges

    def lifted(m: re.Match) -> str:
        width = len(m[1])
        deep = re.match(rf"(?:\n[ \t]*$|\n[ \t]{{{width},}}\S.*$)*", m[3], re.M)
        body = re.sub(rf"\n(?=[ \t]*\S)[ \t]{{{width}}}", "\n", deep[0])
        return m[2] + body + _ITEM_HEADING.sub(lifted, m[3][deep.end() :])

    if not _ITEM_HEADING.search(markdown):
        return markdown
    out, at = [], 0
    for a, b in [*fenced_ranges(markdown), (len(markdown), len(markdown))]:
        out += [_ITEM_HEADING.sub(lifted, markdown[at:a]), markdown[a:b]]
        at = b
    return "".join(out)


def html_to_markdown(page: str | None, links: bool = True) -> tuple[str, str]:
    """(title, Markdown) of a page. The title is the first first-level heading outside code, else
    og:title, else <title>, else Untitled."""
    if not page:
        return "Untitled", ""
    w = _Writer(links)
    w.feed(page)
    w.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(w.out))
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    text = promote_list_headings(text)
    text = re.sub(r"(?m)^(#{1,6}) +(.*?)\s*$", lambda m: f"{m[1]} {re.sub(r'[*`]', '', re.sub(r'!?\[([^\]]*)\]\([^)]*\)', r'\1', m[2])).strip()}", text)
    from sheaf.operators.structure import sections_in

    first = next((s[0] for s in sections_in(text) if s[1] == 1), "")
    title = first or w.og.strip() or re.sub(r"\s+", " ", w.title).strip() or "Untitled"
    return title, text


def needs_scripts(page: str | None) -> bool:
    """A shell that scripts fill: a noscript that says so, or an empty application root."""
    if not page:
        return False
    if any("javascript" in re.sub(r"<[^>]+>", "", m).lower() for m in re.findall(r"<noscript[^>]*>(.*?)</noscript>", page, re.S | re.I)):
        return True
    return any(re.search(rf"<(\w+)[^>]*\bid=[\"']?{r}[\"'\s>][^>]*>\s*</\1>", page) or re.search(rf"<(\w+)\s+id=[\"']?{r}[\"']?\s*>\s*</\1>", page) for r in ROOTS)


def plain_title(raw: str | None) -> str | None:
    """A display title without tags and entities."""
    return None if raw is None else entities.unescape(re.sub(r"<[^>]+>", "", raw)).strip()


def wrap_bare_pre(page: Column) -> Column:
    """<pre> without <code> gets one."""
    return F.when(F.contains(page, F.lit("<pre")), F.regexp_replace(page, r"(?is)<pre([^>]*)>(?!\s*<code)(.*?)</pre>", "<pre$1><code>$2</code></pre>")).otherwise(page)


def unwrap_heading_anchors(page: Column) -> Column:
    """Anchors around headings go, the headings stay."""
    return F.when(F.contains(page, F.lit("<a")), F.regexp_replace(page, r"(?is)<a(?:\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*)?>\s*(<h([1-6])[^>]*>(?:(?!</h\2).)*</h\2>)\s*</a>", "$1")).otherwise(page)


def flatten_heading_blocks(page: Column) -> Column:
    """Block tags inside headings become a blank, however many there are."""
    inside = r"(?is)<h([1-6])\b[^>]*>(?:(?!</h[1-6]>)[\s\S])*?</?(?:div|p|section|br)\b[\s\S]*?</h\1>"
    flat = F.udf(_flatten, "string", useArrow=True)
    return F.when(page.rlike(inside), flat(page)).otherwise(page)


_HEADING_TAG = re.compile(r"(<h([1-6])\b[^>]*>)(.*?)(?=</h\2>)", re.S | re.I)
_BLOCK_TAG = re.compile(r"(?:\s*</?(?:div|p|section|br)\b[^>]*>\s*)+", re.I)


def _flatten(page: str | None) -> str | None:
    return None if page is None else _HEADING_TAG.sub(lambda m: m[1] + _BLOCK_TAG.sub(" ", m[3]).strip(), page)


def markdown_pages(responses: DataFrame, key: str, html: Column) -> DataFrame:
    """(key, title, markdown, needs_scripts) of each page; only the two columns reach Python."""

    def convert(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for p in pages:
            title, text = html_to_markdown(p)
            rows.append((title, text, needs_scripts(p) if not text else False))
        return pd.DataFrame(rows, columns=["title", "markdown", "needs_scripts"])

    udf = F.pandas_udf(convert, "title string, markdown string, needs_scripts boolean")
    return responses.select(key, udf(html).alias("m")).select(key, "m.*")


def interactive_elements(page: str | None, most: int = 50) -> list[tuple[str, str, str]]:
    """(kind, label, target) of links, buttons, inputs and selects in order; a link target counts once."""
    found, seen = [], set()
    for m in re.finditer(r"<(a|button|input|select)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>(.*?(?=</\1>))?", page or "", re.S | re.I):
        tag, attrs, body = m[1].lower(), m[2], re.sub(r"<[^>]+>", "", m[3] or "").strip()
        get = lambda k, s=attrs: (re.search(rf"{k}\s*=\s*[\"']([^\"']*)[\"']", s) or [None, ""])[1]
        target = get("href") if tag == "a" else get("name") or get("id")
        if tag == "a":
            if not target or target in seen:
                continue
            seen.add(target)
        found.append((tag, body or get("placeholder") or get("value") or get("aria-label"), target))
    return found[:most]
