"""Edits: prepared against a snapshot, checked as a whole, then committed as new versions.

An edit changes the few files it names, or those a pattern selects.  Selection and
replacement run as plans over all files; what is prepared in Python is one file at a
time.  Nothing is written before every edit of a request is prepared and checked."""

from __future__ import annotations

import difflib
import hashlib
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import paths
from ..functions import text as tx
from . import code
from .parse import nested_symbols, parses


class EditError(ValueError):
    """code: what is wrong; the message says where."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


# Words that no symbol can be renamed to.
KEYWORDS = frozenset(
    "fn let mut struct enum trait impl mod pub use match if else for while loop return self Self where type const static ref move dyn as in unsafe async await crate super "
    "def class lambda pass yield import from global nonlocal with try except finally raise assert del elif is not and or None True False "
    "function var new delete typeof instanceof void this extends interface export default case switch break continue throw catch".split()
)


@dataclass(frozen=True)
class Span:
    kind: str
    name: str
    start: int
    end: int
    body: str


def resolve_span(text: str, lang: str, symbol: str, start: int | None = None) -> Span:
    """The symbol of a name, or of Container.member (or ::); a first line settles which of several."""
    parts = re.split(r"\.|::", symbol)
    all_ = nested(text, lang)
    found = [s for s in all_ if s.name == parts[-1]]
    for holder in reversed(parts[:-1]):
        outer = [o for o in all_ if o.name == holder]
        found = [s for s in found if any(o.start <= s.start and s.end <= o.end and o is not s for o in outer)]
    if start is not None:
        found = [s for s in found if s.start == start] or found
    if not found:
        raise EditError("SYMBOL_NOT_FOUND", symbol)
    if len(found) > 1:
        raise EditError("AMBIGUOUS", f"{symbol} at lines {', '.join(str(s.start) for s in found)}")
    return found[0]


def nested(text: str, lang: str) -> list[Span]:
    """Symbols, and those inside their bodies."""
    return [Span(kind, name, a, b, body) for _, kind, name, a, b, body in nested_symbols(text, lang)]


def _lines(text: str) -> tuple[list[str], bool]:
    lines = text.split("\n")
    last = len(lines) > 1 and not lines[-1]
    return (lines[:-1] if last else lines), last


def _join(lines: list[str], last: bool) -> str:
    return "\n".join(lines) + ("\n" if last and lines else "")


def replace_body(text: str, span: Span, new: str) -> str:
    lines, last = _lines(text)
    return _join(lines[: span.start - 1] + new.rstrip("\n").split("\n") + lines[span.end :], last)


def replace_anchor(text: str, anchor: str, new: str, span: Span | None = None) -> str:
    """Replace a piece of text that stands exactly once in the file (or the symbol)."""
    scope = span.body if span else text
    n = scope.count(anchor)
    if n == 0:
        loose = re.sub(r"\s+", " ", anchor).strip()
        why = "only its white space differs" if loose and loose in re.sub(r"\s+", " ", scope) else "not found"
        raise EditError("ANCHOR_NOT_FOUND", why)
    if n > 1:
        raise EditError("ANCHOR_NOT_UNIQUE", f"{n} times")
    changed = scope.replace(anchor, new)
    return replace_body(text, span, changed) if span else changed


def leading_start(lines: list[str], start: int) -> int:
    """The first line of the comments and attributes that belong to a symbol."""
    while start > 1 and re.match(r"\s*(///?|#\[|#(?!!)|@\w|\*|/\*)", lines[start - 2]):
        start -= 1
    return start


def delete_symbol(text: str, span: Span) -> str:
    """Without the symbol, and without one of the blank lines around it."""
    lines, last = _lines(text)
    a, b = leading_start(lines, span.start) - 1, span.end
    if b < len(lines) and not lines[b].strip():
        b += 1
    elif a and not lines[a - 1].strip():
        a -= 1
    return _join(lines[:a] + lines[b:], last)


def reindent(block: str, indent: str) -> list[str]:
    own = block.rstrip("\n").split("\n")
    least = min((len(x) - len(x.lstrip(" \t")) for x in own if x.strip()), default=0)
    return [indent + x[least:] if x.strip() else "" for x in own]


def insert(text: str, where: str, new: str, span: Span | None = None) -> str:
    """Insert after or before a symbol, into it (before its end), or at the end of the file."""
    lines, last = _lines(text)
    if where == "end" or span is None:
        return _join((lines if lines != [""] else []) + new.rstrip("\n").split("\n"), True)
    head = lines[span.start - 1]
    indent = head[: len(head) - len(head.lstrip(" \t"))]
    if where == "before":
        at = leading_start(lines, span.start) - 1
        return _join([*lines[:at], *reindent(new, indent), "", *lines[at:]], last)
    if where == "after":
        return _join([*lines[: span.end], "", *reindent(new, indent), *lines[span.end :]], last)
    if where == "into":
        inside = [x for x in lines[span.start : span.end] if x.strip()]
        closed = bool(inside) and inside[-1].strip().startswith("}")
        deep = next((x[: len(x) - len(x.lstrip(" \t"))] for x in inside if len(x) - len(x.lstrip(" \t")) > len(indent)), indent + "    ")
        at = span.end - 1 if closed else span.end
        return _join([*lines[:at], *reindent(new, deep), *lines[at:]], last)
    raise EditError("BAD_LOCATOR", where)


def replace_word(text: str, old: str, new: str, lang: str) -> tuple[str, int]:
    """Rename a whole word in code; comments and strings stay as they are."""
    word = re.compile(rf"(?<![A-Za-z0-9_]){re.escape(old)}(?![A-Za-z0-9_])")
    if lang not in code.CODE:
        return word.subn(new, text)
    skip = re.compile(code.strip_pattern(lang).replace(r"\z", r"\Z"))
    out, at, n = [], 0, 0
    for m in skip.finditer(text):
        piece, k = word.subn(new, text[at : m.start()])
        out += [piece, m[0]]
        at, n = m.end(), n + k
    piece, k = word.subn(new, text[at:])
    return "".join([*out, piece]), n + k


def new_name(name: str) -> str:
    if name in KEYWORDS or not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", name):
        raise EditError("BAD_NAME", name)
    return name


def renamed(old: str, new: str):
    """Column of (text, lang): text and number of replacements of a whole word in code."""
    new_name(new)

    @F.pandas_udf("text string, n long")
    def run(text: pd.Series, lang: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([replace_word(t, old, new, x) for t, x in zip(text, lang, strict=True)], columns=["text", "n"])

    return run


def rename_preview(files: DataFrame, old: str, new: str) -> DataFrame:
    """path, occurrences, new_text of the files that a rename of a whole word changes."""
    held = files.filter(F.contains("text", F.lit(old))).select("path", renamed(old, new)("text", "lang").alias("x"))
    return held.select("path", F.col("x.n").alias("occurrences"), F.col("x.text").alias("new_text")).filter("occurrences > 0")


def bulk_where(scope: list[str], old: str) -> Column:
    if not old:
        raise EditError("EMPTY_ANCHOR", "nothing to replace")
    return paths.in_scope(F.col("path"), scope) & F.contains("text", F.lit(old))


def bulk_replace(files: DataFrame, scope: list[str], old: str, new: str) -> DataFrame:
    """path, occurrences, new_text: every occurrence of a literal in the files of a scope."""
    held = files.filter(bulk_where(scope, old))
    n = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit(old), F.lit("")))) / len(old.encode())
    return held.select("path", n.cast("long").alias("occurrences"), F.replace("text", F.lit(old), F.lit(new)).alias("new_text"))


def unified_diff(path: str, old: str, new: str, cap: int = 160) -> str:
    lines = list(difflib.unified_diff(old.split("\n"), new.split("\n"), f"a/{path}", f"b/{path}", lineterm="", n=3))
    return "\n".join(lines[:cap] + ([f"… +{len(lines) - cap} more lines"] if len(lines) > cap else []))


def diff_counts(pairs: DataFrame) -> DataFrame:
    """path, added, removed lines between old_text and new_text (null: no file, which has no
    lines), from line counts alone (moved lines do not count)."""
    lines_of = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.split(c, "\n", -1))
    both = F.concat(F.transform(lines_of("old_text"), lambda x: F.struct(x.alias("t"), F.lit(-1).alias("d"))), F.transform(lines_of("new_text"), lambda x: F.struct(x.alias("t"), F.lit(1).alias("d"))))
    rows = pairs.select("path", F.explode(both).alias("x"))
    net = rows.groupBy("path", "x.t").agg(F.sum("x.d").alias("d"))
    return net.groupBy("path").agg(F.sum(F.greatest("d", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("removed"))


# Versions: an append-only table path, revision, text, op (put or delete), batch_id.


def latest(versions: DataFrame) -> DataFrame:
    """The current text of every path that is not deleted."""
    order = W.partitionBy("path").orderBy(F.desc("revision"))
    return versions.withColumn("r", F.row_number().over(order)).filter("r = 1 and op = 'put'").drop("r")


def upsert(versions: DataFrame, changes: DataFrame, revision: int, batch_id: int) -> DataFrame:
    """Versions with changes (path, text; null text deletes), but for those that change nothing."""
    now = latest(versions).select("path", F.col("text").alias("old"))
    new = changes.join(now, "path", "left").filter(~F.col("text").eqNullSafe(F.col("old")))
    row = new.select("path", F.lit(revision).cast("long").alias("revision"), "text", F.when(F.col("text").isNull(), "delete").otherwise("put").alias("op"), F.lit(batch_id).cast("long").alias("batch_id"))
    return versions.unionByName(row)


def undo(versions: DataFrame, batches: int, revision: int) -> DataFrame:
    """Versions with the state before the last batches appended as a new one."""
    last = versions.agg(F.max("batch_id")).first()[0] or 0
    first = last - batches + 1
    touched = versions.filter(F.col("batch_id") >= first).select("path").distinct()
    before = latest(versions.filter(F.col("batch_id") < first)).select("path", F.col("text").alias("old"))
    back = touched.join(before, "path", "left").select("path", F.col("old").alias("text"))
    return upsert(versions, back, revision, last + 1)


def session_diff(versions: DataFrame, since: int) -> DataFrame:
    """path, old_text, new_text, change of the paths that differ from what they were after revision `since`."""
    old = latest(versions.filter(F.col("revision") <= since)).select("path", F.col("text").alias("old_text"))
    new = latest(versions).select("path", F.col("text").alias("new_text"))
    both = old.join(new, "path", "full_outer").filter(~F.col("old_text").eqNullSafe(F.col("new_text")))
    change = F.when(F.col("old_text").isNull(), "created").when(F.col("new_text").isNull(), "deleted").otherwise("changed")
    return both.select("path", "old_text", "new_text", change.alias("change"))


def stale(located: DataFrame, wanted: DataFrame) -> DataFrame:
    """locator, state (fresh, stale, gone) of locators (path, name, hash) against the current symbols."""
    hashes = located.select("path", "name", F.substring_index("id", "sha256=", -1).alias("now"))
    per = wanted.join(hashes, ["path", "name"], "left").groupBy("path", "name", "hash")
    agg = per.agg(F.max(F.col("now") == F.col("hash")).alias("same"), F.count("now").alias("n"))
    return agg.select("path", "name", "hash", F.when(F.col("n") == 0, "gone").when(F.col("same"), "fresh").otherwise("stale").alias("state"))


#: Failed requests that are remembered.
RING = 128


def signature_of(edit: dict) -> str:
    return hashlib.sha256(repr(sorted(edit.items())).encode()).hexdigest()[:16]


def check(path: str, text: str, lang: str, before: str) -> None:
    """An edit must not leave a file that read as its language before unreadable."""
    if not parses(text, lang) and parses(before, lang):
        raise EditError("PARSE_ERROR", path)


def unreadable(changed: DataFrame) -> DataFrame:
    """path of changed files (path, text, lang, old) that read as their language before and no longer do."""

    @F.pandas_udf("boolean")
    def broken(text: pd.Series, lang: pd.Series, old: pd.Series) -> pd.Series:
        return pd.Series([not parses(t, x) and parses(o, x) for t, x, o in zip(text, lang, old, strict=True)])

    return changed.filter(broken("text", "lang", "old")).select("path")
