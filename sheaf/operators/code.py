"""Definitions in source files and slices of code.

Python is read with its own parser. For the other languages a line-based reading
finds definitions by their opening line and counts brackets outside strings and
comments for their end; it needs no grammar that is not installed.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.operators.structure import line_chunks

_NAME = r"([A-Za-z_$][\w$]*)"
# fixed values: kinds of definitions and the lines that open them
OPENERS: dict[str, list[tuple[str, str]]] = {
    "script": [("class", rf"^\s*(?:export\s+|default\s+|abstract\s+)*class\s+{_NAME}"), ("interface", rf"^\s*(?:export\s+)?interface\s+{_NAME}"), ("type_alias", rf"^\s*(?:export\s+)?type\s+{_NAME}\s*="), ("function", rf"^\s*(?:export\s+|default\s+|async\s+)*function\s*\*?\s*{_NAME}"), ("lexical", rf"^(?:export\s+)?(?:const|let)\s+{_NAME}"), ("method", rf"^\s+(?:(?:static|async|public|private|protected|get|set)\s+)*{_NAME}\s*\([^;]*\)[^;=]*\{{\s*$")],
    "go": [("method", rf"^func\s*\([^)]*\)\s*{_NAME}\s*\("), ("function", rf"^func\s+{_NAME}\s*[\[(]"), ("type", rf"^type\s+{_NAME}\s")],
    "rust": [("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+|async\s+|const\s+|unsafe\s+)*fn\s+{_NAME}"), ("struct", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+{_NAME}"), ("enum", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+{_NAME}"), ("trait", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+{_NAME}"), ("impl", rf"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?{_NAME}")],
    "java": [("class", rf"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*class\s+{_NAME}"), ("interface", rf"^\s*(?:(?:public|private|protected|static)\s+)*interface\s+{_NAME}"), ("enum", rf"^\s*(?:(?:public|private|protected|static)\s+)*enum\s+{_NAME}"), ("method", rf"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*[\w<>\[\], .?]+\s{_NAME}\s*\([^;{{]*\)[^;{{]*\{{")],
    "c": [("struct", rf"^\s*(?:typedef\s+)?struct\s+{_NAME}\s*\{{?\s*$"), ("enum", rf"^\s*enum\s+{_NAME}\s*\{{?\s*$"), ("function", rf"^(?!\s)(?:[\w*]+[\s*]+)+\*?{_NAME}\s*\([^;]*\)\s*\{{?\s*$")],
}
LANGUAGES = {"py": "python", "js": "script", "jsx": "script", "ts": "script", "tsx": "script", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c"}
_WORDS = {"if", "for", "while", "switch", "catch", "return", "else", "new", "do", "try", "function"}
_QUOTED = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`|//[^\n]*|/\*.*?\*/', re.S)


def definitions(source: str, ext: str) -> list[tuple[str, str, int, int, int, str | None]]:
    """(kind, name, first line, last line, depth, first line of documentation)."""
    language = LANGUAGES.get((ext or "").lstrip(".").lower())
    if not source or language is None:
        return []
    source = source.replace("\r\n", "\n").replace("\r", "\n")
    return _python(source) if language == "python" else _braces(source, language)


def _python(source: str):
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out, stack = [], [(n, 0) for n in reversed(tree.body)]
    while stack:
        node, depth = stack.pop()
        named = isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
        if named:
            doc = ast.get_docstring(node)
            out.append(("class" if isinstance(node, ast.ClassDef) else "function", node.name, node.lineno, node.end_lineno, depth, doc.strip().split("\n")[0].strip() if doc and doc.strip() else None))
        stack += [(c, depth + named) for c in reversed(list(ast.iter_child_nodes(node))) if isinstance(c, ast.stmt) or hasattr(c, "body")]
    return out


def _braces(source: str, language: str):
    # strings and comments as blanks of the same length, so that lines and columns stay
    bare = _QUOTED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    raw, lines = source.split("\n"), bare.split("\n")
    found = []
    for i, line in enumerate(lines):
        for kind, opener in OPENERS[language]:
            m = re.match(opener, line)
            if m and m[1] not in _WORDS:
                found.append((kind, m[1], i, _end(lines, i), _comment(raw, i)))
                break
    out, around = [], []
    for kind, name, a, b, doc in found:
        while around and around[-1] < b:
            around.pop()
        out.append((kind, name, a + 1, b + 1, len(around), doc))
        around.append(b)
    return out


def _end(lines: list[str], i: int) -> int:
    level, seen = 0, False
    for j in range(i, len(lines)):
        for c in lines[j]:
            if c in "{(":
                level += 1
                seen = seen or c == "{"
            elif c in "})":
                level -= 1
        if level <= 0 and (seen or lines[j].rstrip().endswith(";")):
            return j
    return len(lines) - 1


def _comment(lines: list[str], i: int) -> str | None:
    j = i - 1
    while j >= 0 and re.match(r"\s*(?:@\w|#\[)", lines[j]):
        j -= 1
    if j < 0 or not re.match(r"\s*(?://|/\*|\*)", lines[j]):
        return None
    top = j
    while top > 0 and re.match(r"\s*(?://|/\*|\*)", lines[top - 1]) and not re.match(r"\s*/\*", lines[top]):
        top -= 1
    text = "\n".join(lines[top : j + 1])
    text = re.sub(r"(?m)^\s*(?:/\*\*?|\*/|\*(?!/)|///?!?)|\*/\s*$", "", text).strip()
    return text.split("\n")[0].strip() or None if text else None


_DEFS = pa.schema([("key", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("depth", pa.int32()), ("docstring", pa.string())])


def _rows(fn, schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *r) for k, e, s in zip(*(batch.column(c).to_pylist() for c in range(3))) for r in fn(s or "", e or "")]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)], schema=schema)

    return run


def code_definitions(files: DataFrame, key: str, ext: Column, source: str) -> DataFrame:
    """Definition rows of each file; files of unknown languages, and null sources, have none."""
    return files.select(F.col(key).cast("long").alias("key"), ext.alias("ext"), F.col(source).alias("source")).mapInArrow(_rows(definitions, _DEFS), f"`{key}` long, kind string, name string, start_line int, end_line int, depth int, docstring string")


def code_slices(source: str, ext: str, low: int = 100, high: int = 1000) -> list[tuple[int, int, str]]:
    """Slices that begin at definitions, small ones joined up to low, large ones cut by lines; files
    without definitions are cut by lines."""
    source = source.replace("\r\n", "\n").replace("\r", "\n")
    starts = [0]
    for m in re.finditer(r"\n", source):
        starts.append(m.end())
    cuts = sorted({0, *(starts[d[2] - 1] for d in definitions(source, ext) if d[2] <= len(starts))})
    if len(cuts) < 2:
        return line_chunks(source) or []
    parts = [source[a:b] for a, b in zip(cuts, [*cuts[1:], len(source)])]
    joined: list[str] = []
    for p in parts:
        if joined and (len(joined[-1]) < low and len(joined[-1]) + len(p) <= high):
            joined[-1] += p
        else:
            joined.append(p)
    out, at = [], 0
    for p in joined:
        for _, _, t in [(0, 0, p)] if len(p) <= high else line_chunks(p, high) or [(0, 0, p)]:
            out.append((len(out), at, t))
            at += len(t)
    return out


def listing(defs: DataFrame) -> DataFrame:
    """Adds line: a definition as an indented entry."""
    doc = F.when(F.col("docstring") != "", F.concat(F.lit(" — "), "docstring")).otherwise("")
    return defs.withColumn("line", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), "kind", F.lit(" "), "name", F.lit(" (L"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")"), F.coalesce(doc, F.lit(""))))
