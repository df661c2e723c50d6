"""Main body of web pages (problem 6).

Tree-structured graphical model: a page is a tree of its elements (in Markdown
and plain text a chain of blocks) with its lines as leaves, and each node is
main body or not. A line's own evidence comes from a logistic model of what it
looks like and how many other pages carry it; parent-child potentials
say how often a child is what its parent is. Sum-product messages upward and
downward give every line's marginal. Both are trained on pages whose markup
names its regions (main, article; nav, aside, footer, dialog); as the model
sees no such names, it works where markup has none. How much a line's own
evidence weighs is decided by sites held out of the training. Each page is parsed
once; its tree and lines are what is kept of it.
"""

from __future__ import annotations

import html
import marshal
import math
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.session import cut

TRAINING_PAGES = 600  # labelled pages at most: of each site by turns, the least by hash of url
TRAINING_LINES = 100_000  # and so many of their lines: pages are taken in that order until they are full
SCALES = (1.0, 1.5, 2.0, 3.0)  # weights of a line's own evidence against its neighbours'; held-out sites decide

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code em font i img input kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = ("script", "style", "head", "noscript", "template", "svg", "iframe", "object", "select", "textarea", "title")
_CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_BLOCKS = frozenset("div section main article nav aside footer header p h1 h2 h3 h4 h5 h6 ul ol table pre blockquote form dl figure".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
_MAIN_NAMES, _OTHER_NAMES = ("main", "article"), ("nav", "aside", "footer", "header", "dialog")


def decode(content: bytes | None, content_type: str | None) -> str:
    """Text of a response: the charset of content-type, UTF-8 without one; an unknown or wrong one never fails."""
    if not content:
        return ""
    m = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type or "", re.I)
    name = (m[1] if m else "utf-8").lower()
    if name in ("iso-8859-1", "latin-1", "latin1"):
        name = "cp1252"  # as browsers read it
    for bom, real in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(bom):
            name = real
    if name in ("utf-16", "utf16") and content[:2] not in (b"\xff\xfe", b"\xfe\xff"):
        name = "utf-16-be" if content[:1] == b"\0" else "utf-16-le"
    try:
        return content.decode(name, "replace")
    except LookupError:
        return content.decode("utf-8", "replace")


class Page:
    """Tree of a page. Nodes stand after their parents; lines hang on nodes."""

    def __init__(self, text: str, content_type: str | None = None):
        self.parent, self.tag, self.region = [-1], ["root"], [None]
        self.lines: list[dict] = []  # no, node, text, linked, first tag, region
        # what its type calls HTML, or what begins with a tag where the type says nothing, if it has any block at all
        kind = (content_type or "").lower()
        marked = "html" in kind or not re.search(r"text/(?:plain|markdown)", kind) and text.lstrip("\ufeff \t\r\n").startswith("<")
        self.html = marked and re.search(r"<(?:html|body|!doctype|div|p|table)\b", text, re.I) is not None
        if self.html:
            self._read_html(text)
        else:
            self._read_text(text)
        for line in self.lines:
            line["text"] = re.sub(r"\s+", " ", line["text"]).strip()
        self.lines = [x for x in self.lines if re.search(r"\w|[^\x00-\x7f]", x["text"])]

    def dump(self) -> bytes:
        return marshal.dumps((self.html, self.parent, self.tag, self.region, self.lines))

    @classmethod
    def load(cls, data: bytes) -> Page:
        page = cls.__new__(cls)
        page.html, page.parent, page.tag, page.region, page.lines = marshal.loads(data)
        return page

    def _node(self, tag: str, parent: int, region) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.region.append(region)
        return len(self.tag) - 1

    def _read_html(self, text: str) -> None:
        stack: list[tuple[str, int]] = [("root", 0)]
        link = 0
        number, current = 1, None
        silent_tag = ""
        for m in _TOKEN.finditer(text):
            raw = m[0]
            if silent_tag and silent_tag == "head" and m[2] and not m[1] and m[2].lower() == "body":
                silent_tag = ""  # a head left open ends with the body
            if silent_tag:
                if m[2] and m[1] and m[2].lower() == silent_tag:
                    silent_tag = ""
                number += raw.count("\n")
                continue
            if m[2]:
                tag = m[2].lower()
                if tag in _SILENT:
                    if not m[1] and not m[3].endswith("/"):
                        silent_tag = tag
                elif tag == "a":
                    link = 0 if m[1] else 1
                elif tag in _INLINE or tag in _VOID:
                    pass
                elif m[1]:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            del stack[k:]
                            break
                else:
                    if tag in _CLOSES or tag in _BLOCKS:
                        ends = _CLOSES.get(tag, set()) | ({"p"} if tag in _BLOCKS else set())
                        for k in range(len(stack) - 1, 0, -1):
                            if stack[k][0] in ends:
                                del stack[k:]
                                break
                            if stack[k][0] in ("ul", "ol", "table", "div", "section", "article", "main", "body"):
                                break
                    at = stack[-1][1]
                    region = self.region[at]
                    role = re.search(r"role\s*=\s*[\"']?(\w+)", m[3])
                    if tag in _MAIN_NAMES or role and role[1] == "main":
                        region = 1
                    elif tag in _OTHER_NAMES and region != 1 or role and role[1] in ("dialog", "navigation", "banner", "contentinfo", "complementary"):
                        region = 0
                    stack.append((tag, self._node(tag, at, region)))
                    link = 0
                number += raw.count("\n")
            elif m[4]:
                for k, part in enumerate(m[4].split("\n")):
                    if k:
                        number += 1
                    if part.strip():
                        part = html.unescape(part) if "&" in part else part
                        if not part.strip():
                            continue
                        if current is None or current["no"] != number:
                            current = {"no": number, "node": stack[-1][1], "text": "", "linked": 0, "tag": stack[-1][0], "region": self.region[stack[-1][1]]}
                            self.lines.append(current)
                        elif current["node"] != stack[-1][1]:
                            current["text"] += " "
                        current["text"] += part
                        current["linked"] += len(part.strip()) * link
            else:
                number += raw.count("\n")

    def _read_text(self, text: str) -> None:
        """Blocks between blank lines, each the child of the one before."""
        block, fence, fresh = 0, False, True
        for number, line in enumerate(text.split("\n"), 1):
            if re.match(r"^\s*(?:```|~~~)", line):
                fence, fresh = not fence, True
                continue
            if not line.strip() and not fence:
                fresh = True
                continue
            heading = re.match(r"^#{1,6}\s", line) is not None and not fence
            item = _ITEM.match(line) is not None and not fence
            last = self.lines[-1] if self.lines else None
            # a list is one block; else a block ends where few words without a stop begin or end
            if fresh or heading or (last and not fence and not (item and last["tag"] == "li") and (last["tag"][0] == "h" or item or last["tag"] == "li" or _short(line) != _short(last["text"]))):
                block = self._node("pre" if fence else "block", block, None)
            gap, fresh = fresh, False
            linked = sum(len(a) for a in re.findall(r"\[([^\]]*)\]\([^)]*\)", line)) if "](" in line else 0
            shown = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", line)
            tag = "pre" if fence else "h" + str(len(line) - len(line.lstrip("#"))) if heading else "li" if item else "tr" if line.lstrip().startswith("|") else "blockquote" if line.lstrip().startswith(">") else "p"
            self.lines.append({"no": number, "node": block, "text": shown if fence else re.sub(r"^\s*(?:#{1,6}|[-*+•>]|\d+[.)])\s+", "", shown), "linked": linked, "tag": tag, "region": None, "gap": gap})


_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s")


def _short(text: str) -> bool:
    """Few words without a stop: where this changes, one block ends and another begins."""
    text = text.strip()
    return len(text.split()) <= 6 and text[-1:] not in ".?!。:;"


def line_key(text: str) -> int:
    """Alike for lines that differ in case, punctuation, what follows a short lead with a colon and, if they
    have four words, in numbers; 64 bits."""
    import xxhash

    lead = re.match(r"\s*(\w[^:.?!]{2,24}):\s", text)
    words = re.findall(r"\w+", (lead[1] + " lead" if lead else text).lower())
    if len(words) > 3:
        words = ["0" if w.isdigit() else w for w in words]
    return xxhash.xxh64(" ".join(words)).intdigest() - (1 << 63)


def frame_keys(text: str) -> list[int]:
    """Keys of a short line without a stop, less one word each: insertions often carry one word that changes."""
    import xxhash

    if text[-1:] in ".?!。:;":
        return []
    words = ["0" if w.isdigit() else w for w in re.findall(r"\w+", text.lower())]
    if not 5 <= len(words) <= 12:
        return []
    return [xxhash.xxh64(" ".join([*words[:i], "*", *words[i + 1 :]])).intdigest() - (1 << 63) for i in range(len(words))]


FEATURES = 54


def features(page: Page, spread: dict[int, tuple], total: int, plain: bool | None = None) -> np.ndarray:
    """What each line looks like. spread: line -> (pages that carry it, share of
    this site's other pages that do, and in what share of all it is a heading and a link).

    With ``plain`` the tags are not looked at, as in text.
    """
    plain = not page.html if plain is None else plain
    lines = page.lines
    n = len(lines)
    x = np.zeros((n, FEATURES))
    if not n:
        return x
    words = np.array([len(a["text"].split()) for a in lines], dtype=float)
    stop = np.array([a["text"][-1] in ".?!。:;”\"" for a in lines], dtype=float)
    full = np.array([a["text"][-1] in ".?!。" and w > 4 for a, w in zip(lines, words)], dtype=float)
    link = np.array([min(1.0, a["linked"] / max(1, len(a["text"]))) for a in lines])
    # shares of all pages and of the site's other pages, so that they mean the same at every size
    far = np.array([max(0, spread.get(a["no"], (1, 0))[0] - 2) / max(1, total) for a in lines])
    near = np.array([spread.get(a["no"], (1, 0))[1] for a in lines], dtype=float)
    wide = np.log1p(2000 * far)
    often = wide + 2 * near
    first_long = next((i for i in range(n) if full[i] and words[i] >= 8 and often[i] < 0.7), n)
    last_long = next((i for i in range(n - 1, -1, -1) if full[i] and words[i] >= 8 and often[i] < 0.7), -1)
    groups: dict[int, list[int]] = {}
    for i, a in enumerate(lines):
        groups.setdefault(a["node"] if plain else _holder(page, a["node"]), []).append(i)
    for members in groups.values():
        m = np.array(members)
        x[m, 20] = np.log1p(len(m))
        x[m, 21] = full[m].mean()
        x[m, 22] = link[m].mean()
        x[m, 23] = np.log1p(words[m].mean())
        x[m, 24] = np.minimum(3, often[m].mean())
        x[m, 25] = np.minimum(3, often[m].max())
        x[m, 38] = often[m[0]] if len(m) > 1 else 0
        x[m, 41] = (often[m] > 1).mean()
    heading = under = 0.0  # how widely the last heading-like line is spread
    since = 0
    titles = [i for i, a in enumerate(lines) if a["tag"] == "h1"]
    top = titles[0] if titles and not (plain and page.html) else first_long
    for i, a in enumerate(lines):
        t = a["text"]
        tag = a["tag"]
        headish = tag[0] == "h" and tag != "html" if not plain or not page.html else words[i] <= 8 and not stop[i]
        x[i, 0] = 1
        x[i, 1] = np.log1p(words[i])
        x[i, 2] = stop[i]
        x[i, 3] = full[i]
        x[i, 4] = link[i]
        x[i, 5] = min(4, wide[i])
        x[i, 6] = 3 * near[i]
        x[i, 7] = far[i] > 0.002
        x[i, 8] = near[i] > 0.3
        x[i, 9] = "|" in t and not t.startswith("|")
        x[i, 10] = "©" in t or "(c)" in t.lower() or "�" in t[:2]
        x[i, 11] = i < top
        x[i, 12] = i > last_long
        x[i, 13] = (i / n) ** 2
        x[i, 14] = i / n
        x[i, 15] = words[i] <= 3
        x[i, 16] = words[i] <= 6 and not stop[i]
        x[i, 17] = min(3, heading)
        x[i, 18] = min(1, since / 10)
        x[i, 19] = i < first_long
        x[i, 26] = full[i - 1] if i else 0
        x[i, 27] = full[i + 1] if i + 1 < n else 0
        x[i, 28] = min(3, often[i - 1]) if i else 1
        x[i, 29] = min(3, often[i + 1]) if i + 1 < n else 1
        if not plain:
            x[i, 30] = tag == "li"
            x[i, 31] = tag == "p"
            x[i, 32] = tag == "h1"
            x[i, 33] = tag == "h2"
            x[i, 34] = tag in ("h3", "h4")
            x[i, 35] = tag in ("td", "tr", "th")
            x[i, 36] = tag == "button"
            x[i, 50] = tag in ("div", "section", "article", "main", "body", "span")
            x[i, 51] = x[i, 50] and words[i] <= 8
            x[i, 37] = tag in ("pre", "blockquote")
        x[i, 39] = full[i] and often[i] < 0.7
        x[i, 40] = link[i] if words[i] > 6 else 0
        x[i, 42] = x[i, 17] * (1 - x[i, 39])
        x[i, 43] = words[i] <= 8 and not stop[i] and i > last_long
        if far[i] > 0.0005:
            head, linked = spread[a["no"]][2:4]
            x[i, 44] = head
            x[i, 45] = linked
            x[i, 46] = min(4, wide[i]) * (1 - head)
            x[i, 47] = far[i] > 0.002 and head < 0.3 and words[i] <= 8
            x[i, 48] = far[i] > 0.002 and head > 0.6 and linked < 0.3
            x[i, 49] = min(4, wide[i]) * (x[i, 26] and x[i, 27])
        # below a short line that many pages carry, before the next gap: what a site lists
        if a["gap"] if "gap" in a else i and _holder(page, a["node"]) != _holder(page, lines[i - 1]["node"]):
            under = 0.0
        x[i, 52] = under * (1 - full[i])
        x[i, 53] = under * full[i]
        if words[i] <= 6 and not stop[i] and far[i] > 0.002:
            under = 1.0
        if headish:
            heading, since = often[i], 0
        else:
            since += 1
    return x


def _holder(page: Page, node: int) -> int:
    """The region-like element above a line: the nearest that holds several blocks."""
    while page.parent[node] > 0 and page.tag[node] in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "button", "td", "th", "tr", "tbody", "table", "ul", "ol", "pre", "blockquote", "span") and not _layout(page, node):
        node = page.parent[node]
    return node


def _layout(page: Page, node: int) -> bool:
    """A table cell that holds blocks is a region of a layout table."""
    if page.tag[node] not in ("td", "th"):
        return False
    cells = page.__dict__.setdefault("_cells", {page.parent[k] for k in range(len(page.tag)) if page.tag[k] in _BLOCKS or page.tag[k] == "li"})
    return node in cells


def edge_kind(page: Page, child: int) -> str:
    """Kinds of parent-child potentials."""
    p = page.parent[child]
    if page.tag[child] in ("block", "pre") and not page.html:
        return "chain"
    if page.tag[p] in ("root", "html", "body") or _layout(page, child):
        return "top"
    if page.tag[p] in ("table", "tbody", "tr", "ul", "ol"):
        return "item"
    return "inner"


def marginals(page: Page, evidence: np.ndarray, agree: dict[str, float]) -> np.ndarray:
    """P(main body) of each line by sum-product over the tree; evidence: log odds of the lines."""
    nodes = len(page.tag)
    up = np.zeros((nodes, 2))  # log of what comes from below
    table = {k: (math.log(v), math.log(1 - v)) for k, v in agree.items()}

    def through(message: np.ndarray, kind: str) -> np.ndarray:
        same, other = table[kind]
        a, b = message
        return np.array([_plus(same + a, other + b), _plus(other + a, same + b)])

    leaf = [np.array([0.0, e]) for e in evidence]
    sent_line = [through(m, "line") for m in leaf]
    for line, m in zip(page.lines, sent_line):
        up[line["node"]] += m
    kinds = [""] + [edge_kind(page, i) for i in range(1, nodes)]
    sent = np.zeros((nodes, 2))
    for i in range(nodes - 1, 0, -1):
        sent[i] = through(up[i], kinds[i])
        up[page.parent[i]] += sent[i]
    belief = np.zeros((nodes, 2))
    belief[0] = up[0]
    for i in range(1, nodes):
        belief[i] = up[i] + through(belief[page.parent[i]] - sent[i], kinds[i])
    out = np.zeros(len(page.lines))
    for k, (line, m) in enumerate(zip(page.lines, sent_line)):
        b = leaf[k] + through(belief[line["node"]] - m, "line")
        out[k] = 1 / (1 + math.exp(min(700, max(-700, b[0] - b[1]))))
    return out


def _plus(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log(math.exp(a - m) + math.exp(b - m))


def as_text(page: Page, links: bool) -> Page:
    """A labelled page as its Markdown (with links) or plain text would be: regions and blocks apart, tags gone; labels stay."""
    out = Page("")
    out.html, block = False, 0
    for k, (region, items) in enumerate(groupby(page.lines, key=lambda a: (a["region"], _holder(page, a["node"]) if a["region"] != 1 else -1))):
        items, last = list(items), None
        if region[0] == 0 and k % 2 == 0 and not links:  # menus are also written as one line
            menu = [a for a in items if a["linked"] * 2 > len(a["text"]) and len(a["text"].split()) <= 3]
            if len(menu) > 2 and len(menu) == len(items):
                items = [dict(items[0], text=" | ".join(a["text"] for a in menu), no=-items[0]["no"])]
        for a in items:
            kind = a["tag"] if a["tag"] in ("li", "tr", "td", "pre") else None
            item = links and kind == "li"  # Markdown shows the items of a list, text does not
            if last is None or region[0] == 1 and (kind is None or kind != last[0]) or item != (links and last[0] == "li") or not item and _short(a["text"]) != last[1]:
                block = out._node("block", block, region[0])
                gap = last is None or region[0] == 1
            else:
                gap = False
            last = (kind or "x", _short(a["text"]))
            out.lines.append(dict(a, node=block, linked=a["linked"] * links, tag="p", was=a["tag"], gap=gap))
    return out


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 3.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _common(total: int) -> float:
    """How many pages make a line the site's."""
    return max(4, 0.003 * total)


def _views(page: Page, spread: dict[int, tuple], total: int):
    """A labelled page as it is, as plain text and as Markdown, with the labels of its lines."""
    common = _common(total)
    for view, plain in ((page, False), (as_text(page, False), True), (as_text(page, True), True)):
        yield view, plain, [None if a["region"] is None else int(a["region"] == 1 and (a.get("was", a["tag"])[0] == "h" or spread.get(a["no"], (1, 0))[0] < common)) for a in view.lines]


def _examples(page: Page, spread: dict[int, tuple], total: int):
    """Training rows of a labelled page: (plain, label, features) of its lines and (kind, agrees) of its edges.

    A line that many other pages carry belongs to the site, wherever it stands, unless it is a heading.
    """
    rows, edges = [], []
    for view, plain, labels in _views(page, spread, total):
        x = features(view, spread, total, plain)
        rows += [(plain, y, v.tolist()) for y, v in zip(labels, x) if y is not None]
        votes: dict[int, list[int]] = {}
        for a, y in zip(view.lines, labels):
            if y is not None:
                node = a["node"]
                while node > 0:
                    votes.setdefault(node, []).append(y)
                    node = view.parent[node] if not plain else 0
        label = {k: round(sum(v) / len(v)) for k, v in votes.items() if abs(sum(v) / len(v) - 0.5) > 0.2}
        for i in range(1, len(view.tag)):
            if i in label and view.parent[i] in label:
                edges.append((edge_kind(view, i), int(label[i] == label[view.parent[i]])))
        for a, y in zip(view.lines, labels):
            if y is not None and a["node"] in label:
                edges.append(("line", int(y == label[a["node"]])))
    return rows, edges


_DEFAULT_AGREE = {"chain": 0.8, "top": 0.5, "item": 0.95, "inner": 0.95, "line": 0.95}


_PARSED = pa.schema([("fetch_id", pa.int64()), ("site", pa.string()), ("u", pa.int64()), ("labelled", pa.bool_()), ("size", pa.int32()), ("page", pa.binary()), ("keys", pa.list_(pa.struct([("no", pa.int32()), ("key", pa.int64()), ("frame", pa.bool_()), ("head", pa.int32()), ("link", pa.int32())])))])
_PARSED_DDL = "fetch_id long, site string, u long, labelled boolean, size int, page binary, keys array<struct<no:int,key:long,frame:boolean,head:int,link:int>>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Responses to pages without their text but for that of lines, and the keys of their lines."""
    for batch in batches:
        rows = []
        for fetch_id, site, u, content_type, content in zip(*(batch.column(i).to_pylist() for i in range(5))):
            page = Page(decode(content, content_type), content_type)
            keys = []
            for a in page.lines:
                head, link = int(a["tag"][0] == "h" and a["tag"][1:].isdigit()), int(a["linked"] * 2 > len(a["text"]))
                # of a line's keys the one that most pages carry counts
                for k, key in enumerate((line_key(a["text"]), *frame_keys(a["text"]))):
                    keys.append({"no": a["no"], "key": key, "frame": k > 0, "head": head, "link": link})
            rows.append((fetch_id, site, u, {0, 1} <= {a["region"] for a in page.lines}, len(page.lines), page.dump(), keys))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(_PARSED), _PARSED)], schema=_PARSED)


def _pages(batch: pa.RecordBatch):
    for fetch_id, page, spread in zip(*(batch.column(i).to_pylist() for i in range(3))):
        yield fetch_id, Page.load(page), {s["no"]: (s["far"], s["near"], s["head"], s["link"]) for s in sorted(spread or [], key=lambda s: s["far"])}


_EXAMPLE = pa.schema([("fold", pa.int32()), ("plain", pa.bool_()), ("label", pa.int32()), ("x", pa.list_(pa.float32())), ("kind", pa.string()), ("agrees", pa.int32())])
_EXAMPLE_DDL = "fold int, plain boolean, label int, x array<float>, kind string, agrees int"


def _train(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for (_, page, spread), fold in zip(_pages(batch), batch.column(3).to_pylist()):
                rows, edges = _examples(page, spread, total)
                out += [(fold, p, y, v, None, None) for p, y, v in rows]
                out += [(fold, None, None, None, k, y) for k, y in edges]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * len(_EXAMPLE), _EXAMPLE)], schema=_EXAMPLE)

    return run


def _held_out(total: int, models: list[dict]):
    """Errors of each weight on the pages of a fold, by the model of the other folds: (plain, weight, errors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        errors: dict[tuple[bool, float], int] = {}
        for batch in batches:
            for (_, page, spread), fold in zip(_pages(batch), batch.column(3).to_pylist()):
                for view, plain, labels in _views(page, spread, total):
                    model = models[fold]
                    evidence = features(view, spread, total, plain) @ np.array(model["plain" if plain else "html"])
                    for scale in SCALES:
                        got = marginals(view, np.clip(scale * evidence, -15, 15), model["agree"]) > 0.5
                        errors[plain, scale] = errors.get((plain, scale), 0) + sum(y is not None and bool(g) != bool(y) for g, y in zip(got, labels))
        rows = [(p, s, n) for (p, s), n in errors.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 3, (pa.bool_(), pa.float64(), pa.int64()))], names=["plain", "scale", "errors"])

    return run


def _infer(total: int, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, texts, ps = [], [], [], []
            for fetch_id, page, spread in _pages(batch):
                if not page.lines:
                    continue
                kind = "html" if page.html else "plain"
                evidence = features(page, spread, total) @ np.array(model[kind])
                p = marginals(page, np.clip(model["scale"][kind] * evidence, -15, 15), model["agree"])
                for a, q in zip(page.lines, p):
                    ids.append(fetch_id), numbers.append(a["no"]), texts.append(a["text"]), ps.append(float(q))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.array(ps, pa.float64())], names=["fetch_id", "line_no", "text", "p"])

    return run


FOLDS = 2


def body_lines(responses: DataFrame) -> DataFrame:
    """(fetch_id, line_no, text, p): the lines of each page with their probability of being main body.

    Only responses with status 200 and content; re-delivered rows count once.
    Line statistics cover all pages: how many carry a line, and how many of the
    own site, pages fetched again counting once. Without labelled pages every
    line's evidence is its default (long sentences that no other page has).
    """
    content_type = F.get(F.map_values(F.map_filter("headers", lambda k, v: F.lower(k) == "content-type")), F.lit(0))
    pages = (
        responses.where("status_code = 200 AND content IS NOT NULL AND fetch_id IS NOT NULL")
        .select("fetch_id", F.coalesce("url", F.lit("")).alias("url"), content_type.alias("content_type"), "content", "fetched_at")
        .groupBy("fetch_id").agg(F.max_by(F.struct("url", "content_type", "content"), F.struct("fetched_at", F.xxhash64("content"))).alias("v")).select("fetch_id", "v.*")
    )
    site = F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/:?#]+)", 1)
    parsed = cut(pages.select("fetch_id", site.alias("site"), F.xxhash64("url").alias("u"), "content_type", "content").mapInArrow(_parse, _PARSED_DDL))
    where = parsed.select("fetch_id", "site", "u")
    lines = parsed.select("fetch_id", "site", "u", F.explode("keys").alias("k")).select("fetch_id", "site", "u", "k.*")
    # distinct pages before distinct sites, both combined before they are shuffled
    per_page = lines.groupBy("key", "site", "u").agg(F.max("head").alias("head"), F.max("link").alias("link"))
    per_site = per_page.groupBy("key", "site").agg(F.count("*").alias("near"), F.sum("head").alias("head"), F.sum("link").alias("link"))
    # only marked-up pages tell headings and links; a line that stands in plain text alone has none
    far = per_site.groupBy("key").agg(F.sum("near").alias("pages"), F.sum("head").alias("heads"), F.sum("link").alias("links"))
    site_pages = where.groupBy("site").agg(F.count_distinct("u").alias("pages_here"))
    spread_of = per_site.select("key", "site", "near").join(far, "key").where("pages > 1").join(site_pages, "site")
    facts = F.struct("no", F.col("pages").cast("int").alias("far"), ((F.col("near") - 1) / F.greatest(F.col("pages_here") - 1, F.lit(1))).alias("near"), (F.col("heads") / F.col("pages")).alias("head"), (F.col("links") / F.col("pages")).alias("link"))
    total = where.select("u").distinct().count()
    # a frame counts only where so many pages carry it that it is the site's
    counted = lines.join(spread_of, ["key", "site"]).where(~F.col("frame") | (F.col("pages") >= _common(total)))
    spread = cut(counted.groupBy("fetch_id").agg(F.collect_list(facts).alias("spread")))

    # pages of every labelled site by turns, each page once, until there are enough
    named = parsed.where("labelled").groupBy("site", "u").agg(F.min(F.struct("fetch_id", "size")).alias("v")).select("site", "u", "v.*")
    turn = named.withColumn("turn", F.row_number().over(Window.partitionBy("site").orderBy("u"))).where(F.col("turn") <= TRAINING_PAGES)
    first = turn.orderBy("turn", "u").limit(TRAINING_PAGES)
    order = Window.orderBy("turn", "u")  # over TRAINING_PAGES rows at most
    placed = first.withColumn("lines", F.sum("size").over(order)).withColumn("place", F.row_number().over(order)).withColumn("fold", ((F.dense_rank().over(Window.orderBy("site")) - 1) % FOLDS).cast("int"))
    chosen = cut(placed.where((F.col("lines") <= TRAINING_LINES) | (F.col("place") == 1)).select("fetch_id", "fold"))
    sample = parsed.select("fetch_id", "page").join(F.broadcast(chosen), "fetch_id").join(spread, "fetch_id", "left").select("fetch_id", "page", "spread", "fold")
    examples = sample.mapInArrow(_train(total), _EXAMPLE_DDL).toArrow()
    model = _learn(examples)
    folds = set(examples["fold"].to_pylist())
    if len(folds) == FOLDS:
        models = [_learn(examples.filter(pc.not_equal(examples["fold"], k))) for k in range(FOLDS)]
        errors = {(r.plain, r.scale): r.errors for r in sample.mapInArrow(_held_out(total, models), "plain boolean, scale double, errors long").groupBy("plain", "scale").agg(F.sum("errors").alias("errors")).toLocalIterator()}
        model["scale"] = {kind: min(SCALES, key=lambda s: (errors.get((plain, s), 0), s)) for kind, plain in (("html", False), ("plain", True))}
    return parsed.select("fetch_id", "page").join(spread, "fetch_id", "left").select("fetch_id", "page", "spread").mapInArrow(_infer(total, model), "fetch_id long, line_no int, text string, p double")


def _learn(rows: pa.Table) -> dict:
    out = {"agree": dict(_DEFAULT_AGREE), "scale": {"html": SCALES[0], "plain": SCALES[0]}}
    for name, flag in (("html", False), ("plain", True)):
        of = rows.filter(pc.equal(rows["plain"], flag)).combine_chunks()
        y = of["label"].to_numpy().astype(float)
        if len(set(y.tolist())) == 2:
            x = np.asarray(pc.list_flatten(of["x"]).to_numpy(), dtype=float).reshape(len(y), FEATURES)
            out[name] = _fit(x, y, np.ones(len(y))).tolist()
        else:
            w = np.zeros(FEATURES)
            w[0], w[1], w[39], w[5], w[4] = -2, 0.5, 3, -1.5, -3
            out[name] = w.tolist()
    edges = rows.filter(pc.is_valid(rows["kind"]))
    for kind in _DEFAULT_AGREE:
        got = edges.filter(pc.equal(edges["kind"], kind))["agrees"].to_pylist()
        if got:
            out["agree"][kind] = min(0.99, max(0.5, (sum(got) + 1) / (len(got) + 2)))
    return out


def main_bodies(responses: DataFrame) -> DataFrame:
    """(fetch_id, text): the main body of each page, line by line."""
    kept = body_lines(responses).where("p > 0.5")
    return kept.groupBy("fetch_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))


def found(responses: DataFrame) -> DataFrame:
    return body_lines(responses).where("p > 0.5").select("fetch_id", "line_no")
