"""Symbols of source code, by heading words, braces and indentation.

Parsing is line by line with state, so it runs in Python, in batches; a file's
items depend on the file alone and are worth keeping by content hash."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that head an item, by language, the first that fits.
HEADS = {
    "rust": ("fn", "struct", "enum", "trait", "impl", "mod"),
    "javascript": ("function", "class"),
    "typescript": ("function", "class", "interface", "enum", "type"),
    "tsx": ("function", "class", "interface", "enum", "type"),
    "go": ("func", "type"),
    "dart": ("class", "void", "int", "String", "Future"),
    "java": ("class", "interface", "enum", "void", "public", "private"),
    "ruby": ("def", "class", "module"),
    "swift": ("class", "struct", "func", "protocol", "enum"),
    "kotlin": ("class", "fun", "object", "interface"),
    "c": ("struct", "enum", "union", "void", "int", "char"),
    "cpp": ("class", "struct", "namespace", "void", "int", "template"),
    "csharp": ("class", "interface", "struct", "enum", "namespace", "void"),
    "php": ("function", "class", "interface", "trait"),
    "python": ("def", "class"),
}
# Words that may stand before a head.
MODIFIERS = ("pub(crate)", "pub", "async", "unsafe", "default", "export", "static", "abstract", "declare")
SCHEMA = "path string, ord int, kind string, name string, signature string, start int, end int, body string, lang string"
Item = tuple[str, str, int, int]  # kind, header, first line, last line


def _bare(line: str) -> str:
    for m in MODIFIERS:
        if line.startswith(m + " "):
            line = line[len(m) :].lstrip()
    return line


def _head(line: str, words: tuple[str, ...]) -> str | None:
    return next((w for w in words if re.match(rf"{w}(?!\w)", line)), None)


def braces(lines: list[str], words: tuple[str, ...]) -> Iterator[Item]:
    """Items from a heading word to the brace that closes the first one opened; a
    semicolon before any brace ends a declaration.  Items inside one are its own."""
    i = 0
    while i < len(lines):
        header = _bare(lines[i].strip())
        kind = _head(header, words)
        last = i
        if kind:
            depth, opened, done = 0, False, False
            for j in range(i, len(lines)):
                for c in lines[j]:
                    if c == "{":
                        depth, opened = depth + 1, True
                    elif c == "}":
                        depth -= 1
                        done = opened and depth == 0
                    elif c == ";":
                        done = not opened
                    if done:
                        break
                if done:
                    last = j
                    break
            yield kind, header, i + 1, last + 1
        i = last + 1


def indentation(lines: list[str], words: tuple[str, ...] = HEADS["python"]) -> Iterator[Item]:
    """Items that end before the next line that is indented no further."""
    deep = [len(x) - len(x.lstrip(" \t")) for x in lines]
    for i, line in enumerate(lines):
        header = line.lstrip()
        if kind := _head(header, words):
            last = i
            for j in range(i + 1, len(lines)):
                if lines[j].strip():
                    if deep[j] <= deep[i]:
                        break
                    last = j
            yield kind, header, i + 1, last + 1


def item_name(kind: str, header: str) -> str:
    """The name after the heading word; a receiver in parentheses is passed over."""
    rest = _bare(header).removeprefix(kind).lstrip()
    if rest.startswith("(") and ")" in rest:
        rest = rest.split(")", 1)[1].lstrip()
    return re.match(r"\w*", rest)[0]


def signature(header: str) -> str:
    return header.rstrip().rstrip("{").rstrip(":").rstrip()


#: Parsers by language: lines to items.  A session may add its own.
REGISTRY: dict[str, Callable[[list[str]], Iterator[Item]]] = {k: (lambda lines, w=w: braces(lines, w)) for k, w in HEADS.items() if k != "python"}
REGISTRY["python"] = indentation


def split_lines(text: str) -> list[str]:
    out = text.split("\n")
    if len(out) > 1 and not out[-1]:
        out.pop()
    return [x.removesuffix("\r") for x in out]


def parse_symbols(text: str, lang: str, registry: dict | None = None) -> list[tuple[str, str, str, int, int, str]]:
    """kind, name, signature, start, end, body of each item, one per span and kind; none for other languages."""
    parser = (registry or REGISTRY).get(lang)
    if not parser:
        return []
    lines = split_lines(text)
    items = {(a, b, kind): header for kind, header, a, b in reversed(list(parser(lines)))}  # of equal ones the first
    found = sorted(((a, b, kind, header) for (a, b, kind), header in items.items()), key=lambda x: (x[0], -x[1]))
    return [(kind, item_name(kind, header), signature(header), a, b, "\n".join(lines[a - 1 : b])) for a, b, kind, header in found]


def nested_symbols(text: str, lang: str) -> list[tuple[int, str, str, int, int, str]]:
    """depth, kind, name, start, end, body of items and of those inside them, in order."""
    out: list[tuple[int, str, str, int, int, str]] = []
    if lang == "python":  # its items are found at any depth
        open_: list[int] = []
        for kind, name, _, a, b, body in parse_symbols(text, lang):
            while open_ and open_[-1] < a:
                open_.pop()
            out.append((len(open_), kind, name, a, b, body))
            open_.append(b)
        return out
    work = [(0, 0, text)]
    while work:
        depth, before, part = work.pop()
        for kind, name, _, a, b, body in parse_symbols(part, lang):
            out.append((depth, kind, name, a + before, b + before, body))
            inner = body.split("\n", 1)
            if len(inner) > 1:
                work.append((depth + 1, a + before, inner[1]))
    return sorted(out, key=lambda x: (x[3], -x[4], x[0]))


def code_symbols(files: DataFrame, registry: dict | None = None) -> DataFrame:
    """Symbols of files (path, text, lang)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(p, i, *s, lang) for p, t, lang in zip(rows.path, rows.text, rows.lang, strict=True) for i, s in enumerate(parse_symbols(t, lang, registry))]
            if out:
                yield pd.DataFrame(out, columns=["path", "ord", "kind", "name", "signature", "start", "end", "body", "lang"])

    return files.select("path", "text", "lang").mapInPandas(run, SCHEMA)


NODES = "path string, ord int, depth int, field string, kind string, name string, start int, end int"


def python_nodes(text: str) -> list[tuple[int, str, str, str, int, int]]:
    """depth, field, kind, name, start, end of the nodes of Python code in order; 0 for those without a place."""
    import ast

    out, work = [], [(ast.parse(text), 0, "")]
    while work:
        node, depth, field = work.pop()
        name = getattr(node, "name", None) or getattr(node, "id", None) or getattr(node, "attr", None) or getattr(node, "arg", None) or ""
        out.append((depth, field, type(node).__name__, name if isinstance(name, str) else "", getattr(node, "lineno", 0), getattr(node, "end_lineno", 0) or 0))
        inner = [(x, depth + 1, f) for f, v in ast.iter_fields(node) for x in (v if isinstance(v, list) else [v]) if isinstance(x, ast.AST)]
        work += reversed(inner)
    return out


def file_nodes(text: str, lang: str) -> list[tuple[int, str, str, str, int, int]]:
    """Syntax nodes of a file: Python's own, the items of other languages (and of Python that cannot be read)."""
    if lang == "python":
        try:
            return python_nodes(text)
        except (SyntaxError, ValueError):
            pass
    return [(depth, "", kind, name, a, b) for depth, kind, name, a, b, _ in nested_symbols(text, lang)]


def syntax_nodes(files: DataFrame) -> DataFrame:
    """path, ord, depth, field, kind, name, start, end of the syntax nodes of all files, by file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, text, lang in zip(rows.path, rows.text, rows.lang, strict=True):
                if found := file_nodes(text, lang):
                    out = pd.DataFrame(found, columns=["depth", "field", "kind", "name", "start", "end"])
                    yield out.assign(path=path, ord=range(len(out)))[["path", "ord", "depth", "field", "kind", "name", "start", "end"]]

    return files.filter(F.col("lang").isin(*HEADS)).select("path", "text", "lang").mapInPandas(run, NODES)


def node_query(files: DataFrame, q: str, cap: int | None = None) -> DataFrame:
    """path, ord, start, end, kind, name of nodes of a kind, ``kind`` or ``kind name``; the first `cap` matches
    of all files.  Kinds and names are compared as they are."""
    kind, _, name = q.strip().partition(" ")
    found = syntax_nodes(files).filter((F.col("kind") == kind) & (F.col("start") > 0))
    found = found.filter(F.col("name") == name.strip()) if name.strip() else found
    found = found.select("path", "ord", "start", "end", "kind", "name")
    return found.orderBy("path", "ord").limit(cap) if cap else found


#: Lines of a syntax tree that is shown.
SHOWN = 400


def node_tree(files: DataFrame, lines: tuple[int, int] | None = None, cap: int = SHOWN) -> DataFrame:
    """path, tree: the nodes of each file (or those that touch a range of lines), one indented line each."""
    at = F.when(F.col("start") > 0, F.format_string(" L%d-%d", "start", "end")).otherwise("")
    line = F.concat(F.expr("repeat('  ', depth)"), F.when(F.col("field") != "", F.concat("field", F.lit(": "))).otherwise(""), "kind", F.when(F.col("name") != "", F.concat(F.lit(" "), "name")).otherwise(""), at)
    rows = syntax_nodes(files)
    if lines:
        rows = rows.filter((F.col("start") <= lines[1]) & (F.col("end") >= lines[0]))
    listed = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("x"))
    return listed.select("path", F.array_join(F.transform(F.slice("x", 1, cap), lambda s: s["line"]), "\n").alias("tree"))


def balanced(text: str) -> bool:
    """Whether (), [] and {} match outside strings and line comments."""
    stack, i = [], 0
    while i < len(text):
        c = text[i]
        if text.startswith("//", i) or c == "#":
            i = text.find("\n", i)
            if i < 0:
                break
        elif c in "\"'`":
            j = i + 1
            while j < len(text) and text[j] != c and text[j] != "\n":
                j += 2 if text[j] == "\\" else 1
            i = j
        elif c in "([{":
            stack.append(c)
        elif c in ")]}":
            if not stack or stack.pop() + c not in ("()", "[]", "{}"):
                return False
        i += 1
    return not stack


def parses(text: str, lang: str) -> bool:
    """Whether an edited file still reads as its language; languages without a grammar pass if braces match."""
    if lang == "python":
        import ast

        try:
            ast.parse(text)
        except SyntaxError:
            return False
        return True
    return lang not in HEADS or balanced(text)
