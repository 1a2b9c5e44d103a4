"""Patterns, tokens and sizes of text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Identifiers that the token index holds: three characters or more.
IDENT = "[A-Za-z_][A-Za-z0-9_]{2,}"
META = set("\\.+*?()|[]{}^$#&-~/ ")


def escape(literal: str) -> str:
    """A pattern that matches the literal, for Java's and Python's regular expressions."""
    return "".join(f"\\{c}" if c in META and c != " " and c != "/" else c for c in literal)


def has_upper(s: str, ascii_only: bool = False) -> bool:
    return any("A" <= c <= "Z" if ascii_only else c.isupper() for c in s)


def smart_case(pattern: str, *others: str) -> str:
    """Without an upper-case character (in any of the operands) the match ignores case."""
    return pattern if has_upper(pattern + "".join(others)) else f"(?i){pattern}"


def line_pattern(q: str) -> str:
    """Smart-case pattern of a query; one that is no regular expression is a literal."""
    try:
        re.compile(q)
    except re.error:
        return smart_case(escape(q), q)
    return smart_case(q)


def is_plain_ident(q: str) -> bool:
    return len(q.strip()) >= 3 and re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", q.strip()) is not None


def lines(text: Column) -> Column:
    """Lines as an editor counts them: an empty text has one, a final newline opens none."""
    parts = F.split(text, "\n", -1)
    return F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def identifiers(text: Column) -> Column:
    """Distinct identifiers in lower case, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z_][a-z0-9_]{2,}"), F.lit(0))))


def subwords(name: Column) -> Column:
    """Parts of a name between case changes and other characters, in lower case, two bytes or more."""
    cut = F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"))
    return F.filter(F.split(cut, r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) >= 2)


def py_subwords(q: str) -> list[str]:
    cut = re.sub("([a-z])([A-Z])", r"\1 \2", q).lower()
    return [w for w in re.split(r"[\W_]+", cut) if len(w.encode()) >= 2]


# Words of a query that are never taken for the name of a symbol.
STOP = frozenset(
    "this that with from what when where does have into then they will your some more than using used make "
    "made work works code handle return value call called calls file files text name names path paths line lines "
    "list lists item items data node nodes span spans type types test tests main args self true false null none "
    "size index result".split()
)


def mention_words(q: str) -> list[str]:
    """Words of a query that may name a symbol."""
    return sorted({w.lower() for w in re.split(r"[^\w]", q) if len(w.encode()) >= 4 and w.lower() not in STOP})


def est_tokens(text: Column) -> Column:
    """Estimated model tokens: a quarter of the bytes, at least one."""
    return F.greatest(F.lit(1), F.floor(F.octet_length(text) / 4)).cast("long")


def contains_literal(text: Column, word: str, fold: bool) -> Column:
    return F.contains(F.lower(text), F.lit(word.lower())) if fold else F.contains(text, F.lit(word))


def boolean_predicate(text: Column, all_of: list[str] = (), any_of: list[str] = (), none_of: list[str] = (), base: str = "") -> Column:
    """Every one of all_of, one of any_of, none of none_of, and the base pattern; smart case over all of them."""
    words = [*all_of, *any_of, *none_of]
    if len(words) > 64:
        raise ValueError("a boolean search takes 64 operands at most")
    fold = not any(has_upper(w) for w in [*words, base])
    out = F.lit(True)
    for w in all_of:
        out = out & contains_literal(text, w, fold)
    if any_of:
        some = F.lit(False)
        for w in any_of:
            some = some | contains_literal(text, w, fold)
        out = out & some
    for w in none_of:
        out = out & ~contains_literal(text, w, fold)
    if base:
        out = out & text.rlike(("(?i)" if fold else "") + base)
    return out


def required_literals(pattern: str) -> list[str]:
    """Identifiers that every match of a pattern holds, in lower case; none if that cannot be told.

    Used to keep files out of a scan: sound for any pattern, since a pattern with
    alternatives, groups, classes or repetition counts is given up."""
    if any(c in pattern for c in "|()[]{}?*\\"):
        return []
    # an identifier that touches an operator may be longer or shorter in a match
    pieces = re.split(r"[.+^$]", pattern)
    out = []
    for k, piece in enumerate(pieces):
        words = re.findall("[A-Za-z_][A-Za-z0-9_]*", piece)
        if words and k + 1 < len(pieces) and piece.endswith(words[-1]):
            words[-1] = words[-1][:-1]
        out += [w.lower() for w in words if len(w) >= 3]
    return out


def sanitize(text: Column) -> Column:
    """Text for an envelope: its delimiters and line breaks made harmless."""
    return F.regexp_replace(F.translate(text, "⟦⟧", "[]"), r"[\r\n\t]+", " ")
