"""Wiki pages: footnotes, author-date citations, Markdown without navigation."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from sheaf.operators.html import html_to_markdown

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    """An element with its attributes and children (elements and strings)."""

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack += list(reversed(n.children))
        return re.sub(r"\s+", " ", " ".join(x.strip() for x in out if x.strip())).strip()

    def has(self, cls: str) -> bool:
        return cls in (self.attrs.get("class") or "").split()

    def drop(self) -> None:
        self.parent.children.remove(self)

    def replace(self, text: str) -> None:
        self.parent.children[self.parent.children.index(self)] = text

    def html(self) -> str:
        import html as h

        inner = "".join(c.html() if isinstance(c, Node) else h.escape(c, quote=False) for c in self.children)
        if self.tag == "#":
            return inner
        attrs = "".join(f' {k}="{h.escape(v or "")}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" + ("" if self.tag in _VOID else f"{inner}</{self.tag}>")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag == "li":
            n = self.at
            while n.parent is not None and n.tag not in ("ul", "ol", "li"):
                n = n.parent
            if n.tag == "li":
                self.at = n.parent
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(page: str | None) -> Node:
    b = _Builder()
    b.feed(page or "")
    b.close()
    return b.root


def _external(node: Node) -> tuple[str, str] | None:
    a = next((n for n in node.walk() if n.tag == "a" and n.has("external") and n.attrs.get("href")), None)
    return (a.attrs["href"], a.text()) if a else None


def _source(root: Node, anchor: str) -> dict | None:
    target = next((n for n in root.walk() if n.attrs.get("id") == anchor), None)
    if target is None or target.parent is None:
        return None
    link = _external(target.parent)
    return {"text": target.parent.text(), "url": link and link[0], "title": link and link[1]}


def footnotes(page: str | None) -> list[dict]:
    """n, text, url, title, sources of the numbered footnotes: those of the largest list of references,
    counted by place, with the bibliography entries that author-date links point at."""
    root = tree(page)
    lists = [n for n in root.walk() if n.tag == "ol" and n.has("references")]
    if not lists:
        return []
    items = lambda ol: [n for n in ol.walk() if n.tag == "li"]
    out = []
    for n, li in enumerate(items(max(lists, key=lambda ol: len(items(ol)))), 1):
        body = next((x for x in li.walk() if x.has("reference-text")), None)
        if body is None:
            continue
        link = _external(body)
        anchors = [a.attrs["href"].lstrip("#") for a in body.walk() if a.tag == "a" and (a.attrs.get("href") or "").startswith("#CITEREF")]
        out.append({"n": n, "text": body.text(), "url": link and link[0], "title": link and link[1], "sources": [s["text"] for s in (_source(root, x) for x in anchors) if s]})
    return out


def author_date_citations(page: str | None) -> list[dict]:
    """key, href, shorthand, text, url, title of the citations in prose, each once, in order; those whose
    entry is missing are left out."""
    root = tree(page)
    for n in [n for n in root.walk() if n.has("mw-references-wrap")]:
        n.drop()
    out, seen = [], set()
    for a in root.walk():
        href = a.attrs.get("href") or ""
        key = href.lstrip("#")
        if a.tag == "a" and href.startswith("#CITEREF") and key not in seen:
            seen.add(key)
            entry = _source(root, key)
            if entry:
                out.append({"key": key, "href": href, "shorthand": a.text(), **entry})
    return out


def wiki_markdown(page: str | None) -> str:
    """A wiki page's Markdown: no contents, navigation boxes, edit links or reference lists; footnote
    marks as [^n], formulas as their source."""
    root = tree(page)
    for n in list(root.walk()):
        if n.parent is None or n not in n.parent.children:
            continue
        if n.attrs.get("id") == "toc" or any(n.has(c) for c in ("toc", "mw-editsection", "navbox", "navbox-styles", "sistersitebox", "mw-references-wrap")) or n.tag in ("script", "style") or n.tag == "img" and "mwe-math-fallback" in (n.attrs.get("class") or ""):
            n.drop()
        elif n.tag == "p" and n.text().startswith("Cite error:"):
            n.drop()
        elif n.tag == "sup" and n.has("reference"):
            m = re.match(r"\[(\d+)\]", n.text().replace(" ", ""))
            n.replace(f"[^{m[1]}]") if m else n.drop()
        elif n.tag == "math":
            source = next((x.text() for x in n.walk() if x.tag == "annotation" and x.attrs.get("encoding") == "application/x-tex"), n.attrs.get("alttext") or "")
            n.replace(f" ${source}$ " if source else "")
    return html_to_markdown(root.html())[1]
