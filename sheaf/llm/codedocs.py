"""Functions paired with their documentation (problem 5).

One recursive pattern for each family of languages captures the comment, the
signature and the balanced body of a definition together; strings and comments
are alternatives of their own at every level, so that braces and definitions
inside them don't count. Captures whose documentation says nothing are dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.sources.tables import latest

LANGUAGES = {"py": "python", "ts": "script", "tsx": "script", "js": "script", "jsx": "script", "mjs": "script", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c"}

_STRING = r"""(?>"(?:[^"\\\n]|\\[\s\S])*+"|'(?:[^'\\\n]|\\[\s\S])*+')"""
_TEMPLATE = r"(?>`(?:[^`\\]|\\[\s\S])*+`)"
_RUST_STRING = r"""(?>r\#*"[\s\S]*?"\#*|"(?:[^"\\]|\\[\s\S])*+"|'(?:[^'\\\n]|\\[^\n]{1,9}?)')"""
_C_COMMENT = r"(?>/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*)"
_GAP = rf"(?>\s|{_C_COMMENT})*+"


def _braced(string: str, comment_above: str, signature: str) -> str:
    """The pattern of a language with braces. Groups: doc, name, body, keep (what is skipped whole)."""
    return rf"""(?xm)
    (?(DEFINE)
      (?P<str>{string})
      (?P<com>{_C_COMMENT})
      (?P<par>\((?>[^()"'`/]++|(?&str)|(?&com)|(?&par)|['"`/])*+\))
      (?P<ang><(?>[^<>(){{}};"]++|(?&ang))*+>)
      (?P<gap>(?>\s|(?&com))*+)
      (?P<block>\{{(?>[^{{}}"'`/]++|(?&str)|(?&com)|(?&block)|['"`/])*+\}})
    )
    (?:
      ^[\ \t]*(?P<doc>{comment_above})?+(?P<above>{_ABOVE})(?P<sig>[\ \t]*{signature})(?=(?&gap)(?P<body>(?&block)|;)?)
      | (?P<keep>(?&com)|(?&str))
    )"""


# comments each of which begins its own line, the last ending the line above the definition
_DOC = r"(?>(?>/\*[\s\S]*?\*/|//[^\n]*)[\ \t]*\n[\ \t]*)++"
# attributes and annotations may stand between
_ABOVE = r"""(?>[\ \t]*(?>\#!?\[(?>[^\[\]"]++|"(?:[^"\\]|\\.)*+"|\[[^\[\]]*+\])*+\]|@(?!interface\b)[\w.]++(?:[\ \t]*(?&par))?)(?>[\ \t]*\n)?[\ \t]*)*+"""

_SIGNATURES = {
    "script": r"""(?>
        (?>export\s+|default\s+|declare\s+|async\s+)*+function\s*\*?\s*(?P<name>[\w$]+)
      | (?>export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=\s*(?>async\s+)?(?=(?:function\b|(?&ang)?(?&par)\s*(?::[^=\n]+)?=>|[\w$]+\s*=>))
      | (?>(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*+\*?\s*(?P<name>(?!(?:if|for|while|switch|catch|function|return|with|do|else|new|typeof|await|super|throw|yield|case)\b)\#?[\w$]+)(?=\s*(?&ang)?\s*(?&par)\s*(?::[^;{=\n]+)?\s*\{)
      )\s*(?&ang)?\s*(?&par)?\s*(?::(?>[^;{=\n]|=>)+)?(?:=>)?""",
    "go": r"func\s*(?P<recv>(?&par)\s*)?(?P<name>\w+)\s*(?:\[[^\]\n]*\])?\s*(?&par)[^{\n]*",
    "rust": r"""(?>(?:pub(?:\s*\([^)]*\))?|default|const|async|unsafe|extern(?:\s*"[^"]*")?)\s+)*+fn\s+(?P<name>\w+)\s*(?&ang)?\s*(?&par)(?>[^{;]*)""",
    "java": r"""(?>(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*+(?>(?&ang)\s*)?
        (?:(?!(?:return|new|throw|else|case|package|import|class|interface|enum|record|assert|yield|goto)\b)[\w.$]+(?:\s*(?&ang))?(?:\s*\[\s*\])*(?:\s*\.\.\.)?\s+)?
        (?P<name>(?!(?:if|for|while|switch|catch|try|synchronized|return|new|super|this|throw|else|do)\b)[\w$]+)\s*(?&par)(?:\s*throws\s+[\w.,\s]+?)?(?=(?&gap)[{;])""",
    "c": r"""(?!(?:return|else|case|goto|typedef|if|for|while|switch|do|\#)\b)(?>(?:[A-Za-z_]\w*\b(?!\s*\()|\*)\s*)++(?P<name>(?!(?:if|for|while|switch|return|sizeof)\b)[A-Za-z_]\w*)\s*(?&par)(?=(?&gap)\{)""",
}

_PYTHON = r"""(?xm)
    (?(DEFINE)
      (?P<str>(?>[rRbBuUfF]{0,2}(?>\"{3}(?>[^"\\]|\\[\s\S]|"(?!""))*+\"{3}|'{3}(?>[^'\\]|\\[\s\S]|'(?!''))*+'{3}|"(?:[^"\\\n]|\\[\s\S])*+"|'(?:[^'\\\n]|\\[\s\S])*+')))
      (?P<com>\#[^\n]*)
      (?P<par>[(\[{](?>[^()\[\]{}"'\#]++|(?&str)|(?&com)|(?&par)|["'])*+[)\]}])
    )
    (?:
      ^(?P<indent>[\ \t]*)(?P<sig>(?:async[\ \t]+)?def[\ \t]+(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*(?&par)\s*(?:->(?>[^:\n\[\]"']++|(?&par)|(?&str))+)?:)
      (?=(?>\s*(?:\#[^\n]*\n)?)*+(?P<doc>(?&str))?)
      | (?P<keep>(?&str)|\#[^\n]*)
    )"""


@lru_cache(None)
def _pattern(language: str):
    import regex

    if language == "python":
        return regex.compile(_PYTHON)
    string = {"script": rf"(?>{_STRING}|{_TEMPLATE})", "go": rf"(?>{_STRING}|(?>`[^`]*`))", "rust": _RUST_STRING}.get(language, _STRING)
    return regex.compile(_braced(string, _DOC, _SIGNATURES[language]))


def definitions(source: str, language: str) -> list[dict]:
    """Every function and method: name, start_line, end_line, doc (markers removed, None without any), code."""
    source = source.replace("\r\n", "\n").replace("\r", "\n")
    lines = _Lines(source)
    out = []
    for m in _pattern(language).finditer(source):
        if m["name"] is None:
            continue
        begin = m.start("sig") + len(m["sig"]) - len(m["sig"].lstrip())
        if language == "python":
            end = lines.python_end(m.end(), len(m["indent"]))
            raw = m["doc"]
            doc = python_doc(raw) if raw else None
            kind = "method" if m["indent"] and lines.in_class(m.start()) else "function"
        else:
            if m["body"] == ";" and (language in ("c", "script", "go") or m["sig"].lstrip().startswith(m["name"])):
                continue  # a prototype or a call
            end = m.end("body") if m["body"] else m.end()
            doc = comment_doc(m["doc"]) if m["doc"] else None
            kind = "method" if language == "java" or m["sig"][:1] in " \t" or m.groupdict().get("recv") else "function"
        out.append({"name": m["name"], "kind": kind, "start_line": lines.of(m.start("name")), "end_line": lines.of(max(end - 1, begin)), "doc": doc, "code": source[begin:end]})
    return out


class _Lines:
    """Lines of a source by position, and which of them begin inside a triple-quoted string."""

    def __init__(self, source: str):
        self.source = source
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]
        self._quoted: list[tuple[int, int]] | None = None
        self._methods: set[int] | None = None

    def of(self, position: int) -> int:
        return bisect_right(self.starts, position)

    def text(self, k: int) -> str:
        """Line k, counted from 0."""
        return self.source[self.starts[k] : self.starts[k + 1] - 1 if k + 1 < len(self.starts) else len(self.source)]

    def quoted(self, k: int) -> bool:
        if self._quoted is None:
            self._quoted = [m.span() for m in re.finditer(r"\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}", self.source)]
        at = bisect_right(self._quoted, (self.starts[k], -1)) - 1
        return at >= 0 and self._quoted[at][0] < self.starts[k] < self._quoted[at][1]

    def python_end(self, end: int, depth: int) -> int:
        """End of a Python body: before the next line, outside strings, that is not indented deeper."""
        for k in range(self.of(end), len(self.starts)):
            line = self.text(k)
            if not line.strip():
                continue
            if self.quoted(k):
                end = self.starts[k] + len(line)
                continue
            indent = len(line) - len(line.lstrip())
            if indent > depth:
                end = self.starts[k] + len(line)
            elif not line.lstrip().startswith(("#", ")")):
                break
        return end

    def in_class(self, at: int) -> bool:
        """Whether the nearest definition around that of a position is a class."""
        if self._methods is None:
            self._methods, around = set(), []
            for m in re.finditer(r"^([ \t]*)(class|def|async[ \t]+def)\b", self.source, re.M):
                while around and around[-1][0] >= len(m[1]):
                    around.pop()
                if around and around[-1][1]:
                    self._methods.add(m.start())
                around.append((len(m[1]), m[2] == "class"))
        return at in self._methods


def python_doc(raw: str) -> str:
    """A docstring's text without quotes and common indentation."""
    body = re.sub(r"^[rRbBuUfF]{0,2}", "", raw)
    body = body[3:-3] if body[:3] in ('"""', "'''") else body[1:-1]
    return _dedent(body)


def comment_doc(raw: str) -> str:
    """A comment's text without markers, tool directives, dividers and disabled code."""
    parts = re.findall(r"/\*[\s\S]*?\*/|//[^\n]*", raw)
    lines = []
    for part in parts:
        if part.startswith("/*"):
            inner = re.sub(r"^/\*+!?|\*+/$", "", part)
            lines += [re.sub(r"^[ \t]*\*(?!\w)[ \t]?", "", x) for x in inner.split("\n")]
        else:
            lines.append(re.sub(r"^//[/!]?[ ]?", "", part))
    return _dedent("\n".join(x for x in lines if not _noise(x)))


def _dedent(text: str) -> str:
    return "\n".join(x.strip() for x in text.strip().split("\n")).strip()


_DIRECTIVE = re.compile(
    r"^\s*(?:eslint|tslint|jshint|jslint|prettier|istanbul|c8|v8|ts-(?:ignore|expect-error|nocheck|check)|@ts-|noqa|pylint|mypy|flake8|ruff|type:\s*ignore|pragma|nolint|lint:|go:|\+build|clang-(?:format|tidy)|NOLINT|NOSONAR|CHECKSTYLE|noinspection|rustfmt|clippy|cppcheck|coverity|fallthrough|region\b|endregion\b|webpack|@?jsx|sourceMappingURL|spell-?checker|cspell|codespell|language=|formatter:|export\s+\w+$)",
    re.I,
)
_CODE = re.compile(r"""^\s*(?:[\w.$\[\]*&]+\s*(?::?=|[-+*/|&]=)(?!=)\s*\S.*|(?:return|throw|break|continue|import|from|use|package|const|let|var|if|for|while)\b.*[;{(].*|[\w.$:]+\([^)]*\)\s*[;{]?|.*[;{}]\s*|[)}\]];?)$""")


def _noise(line: str) -> bool:
    """Tool directives, dividers and disabled code. Blank lines stay."""
    text = line.strip()
    if not text:
        return False
    if re.match(r"^[-=*#~_+]{3,}.*[-=*#~_+]{3,}$", text):
        return True
    return not re.search(r"\w", text) and len(text) > 3 or bool(_DIRECTIVE.match(text)) or bool(_CODE.match(text) and not re.search(r"[.!?]$", text))


_FILLER = frozenset("a an the this that these those it its is are was be of to for from in on at by with and or as function functions method methods func fn procedure helper routine does do did done given implements implement implementation here which will can should".split())
_PLACEHOLDER = re.compile(
    r"^(?:(?:todo|fixme|xxx|tbd|tba|hack|wip|placeholder|n/?a|none|null|nil|undocumented|no ?docs?(?:umentation)?(?: yet)?|missing docs?|to be (?:done|documented|written|determined)|(?:add|write|insert|needs?) (?:a |some |the )?(?:docs?|docstrings?|documentation|description|comments?)(?: here)?|(?:docs?|documentation|description) (?:goes )?here|document (?:this|me)|description|summary|docstring|documentation|see above|ditto|self[- ]explanatory|\.\.\.|…|[-_.?*=#~/\s]+)[\s.:!…-]*)+$",
    re.I,
)
_TODO = re.compile(r"^\s*(?:todo|fixme|xxx|hack)\b(?:\([^)]*\))?[:\s-]*(.*)$", re.I)
_TAG = re.compile(r"^\s*(?:@\w+|:\w+[^:\n]*:|\\(?:param|return|brief)\b|#\s*(?:arguments|panics|errors|safety|examples?|returns?)\s*$|(?:args|arguments|parameters|params|returns?|raises|throws|yields|examples?|notes?)\s*:\s*$)", re.I)


def name_words(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name.replace("_", " "))]


def stem(word: str) -> str:
    """A word without its inflection, alike for the forms of one verb or noun."""
    w = word
    for suffix in ("ing", "ied", "ies", "ers", "ors", "ed", "er", "or", "es", "s"):
        if w.endswith(suffix) and len(w) - len(suffix) >= 2:
            w = w[: -len(suffix)] + ("y" if suffix in ("ied", "ies") else "")
            break
    if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "aeiou":
        w = w[:-1]
    return w[:-1] if len(w) > 3 and w[-1] == "e" else w


def says_something(doc: str | None, name: str) -> bool:
    """Whether documentation is worth keeping: not empty, no placeholder, not bare tags, and more
    than the function's own words in any inflection with filler words."""
    if doc is None:
        return False
    own = {stem(w) for w in name_words(name)} | {w for w in name_words(name)} | {"".join(name_words(name))}
    in_tags = False
    for line in doc.split("\n"):
        text = line.strip()
        if not text:
            continue
        if _TAG.match(text):
            in_tags = True
            continue
        if in_tags and (re.match(r"^[\w*`.\[\]]+(?:\s*\([^)]*\))?\s*:", text)):
            continue
        if in_tags and not re.match(r"^[A-Z]", text):
            continue
        in_tags = False
        if _PLACEHOLDER.match(text) or _TODO.match(text):
            continue
        words = [w.lower() for w in re.findall(r"[^\W_]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", text))]
        if any(w not in _FILLER and stem(w) not in own and w not in own for w in words):
            return True
    return False


_OUT = pa.schema([("file_id", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("docstring", pa.string()), ("code", pa.string())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file_id, path, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
            language = LANGUAGES.get((path or "").rpartition(".")[2].lower())
            if language is None or not source:
                continue
            for d in definitions(source, language):
                if says_something(d["doc"], d["name"]):
                    rows.append((file_id, d["kind"], d["name"], d["start_line"], d["end_line"], d["doc"], d["code"]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(_OUT), _OUT)], schema=_OUT)


def documented_functions(source_files: DataFrame) -> DataFrame:
    """One row for each function or method with documentation worth keeping.

    The language follows from the path; a file without a known ending, and a
    null or empty source, gives no row. Re-delivered files count once, copied
    files each. A hot repository does not matter: rows are split by file.
    """
    files = latest(source_files.where("file_id IS NOT NULL"), ["file_id"], "fetched_at", ["path", "source"])
    return files.where("source IS NOT NULL AND source <> ''").select("file_id", "path", "source").mapInArrow(_extract, "file_id long, kind string, name string, start_line int, end_line int, docstring string, code string")


def found(source_files: DataFrame) -> DataFrame:
    return documented_functions(source_files).select("file_id", "start_line", "name").distinct()
