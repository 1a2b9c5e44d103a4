"""Code without its comments and strings."""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BAR = "|"
#: Languages whose single quotes delimit characters, not strings.
CHAR_QUOTE = ("rust", "go", "java", "kotlin", "swift", "c", "cpp", "csharp")
HASH_COMMENT = ("python", "ruby")
BACKTICK = ("javascript", "typescript", "tsx", "go")
TRIPLE = ("python", "dart")
CODE = ("rust", "python", "tsx", "typescript", "javascript", "go", "dart", "java", "ruby", "swift", "kotlin", "c", "cpp", "csharp", "php")


def strip_pattern(lang: str) -> str:
    """Comments, strings and characters of a language, as one pattern; what is not closed runs to the end.

    ``//`` and ``/*`` begin comments whatever the language."""
    parts = [r"//[^\n]*"]
    if lang in HASH_COMMENT:
        parts.append(r"#[^\n]*")
    parts.append(r"/\*[\s\S]*?(?:\*/|\z)")
    if lang == "rust":
        parts.append(r'(?<![A-Za-z0-9_])r(#*+)"[\s\S]*?(?:"\1|\z)')
    if lang in TRIPLE:
        parts += [r'"""[\s\S]*?(?:"""|\z)', r"'{3}[\s\S]*?(?:'{3}|\z)"]
    parts.append(r'"(?:\\[\s\S]|[^"\\])*+\\?(?:"|\z)')
    if lang in CHAR_QUOTE:
        parts += [r"'\\[\x00-\x7f]'", r"'[\x00-\x26\x28-\x5b\x5d-\x7f]'", "'"]
    else:
        parts.append(r"'(?:\\[\s\S]|[^'\\])*+\\?(?:'|\z)")
    if lang in BACKTICK:
        parts.append(r"`[^`]*+(?:`|\z)")
    return BAR.join(parts)


def _by_language(text: Column, lang: Column, change) -> Column:
    """change(text, pattern) for code, the text itself for all else."""
    out = None
    groups: dict[str, list[str]] = {}
    for name in CODE:
        groups.setdefault(strip_pattern(name), []).append(name)
    for pattern, names in groups.items():
        new = change(text, pattern)
        out = F.when(lang.isin(*names), new) if out is None else out.when(lang.isin(*names), new)
    return out.otherwise(text)


def stripped(text: Column, lang: Column) -> Column:
    """Text with comments and strings replaced by a semicolon (which ends a call position)."""
    return _by_language(text, lang, lambda t, p: F.regexp_replace(t, p, ";"))


@cache
def literals(lang: str) -> re.Pattern:
    return re.compile(strip_pattern(lang).replace(r"\z", r"\Z"))


def strip_text(text: str, lang: str) -> str:
    """As stripped(); line breaks inside comments and strings stay, so that line numbers hold."""
    if lang not in CODE:
        return text
    return literals(lang).sub(lambda m: ";" + "\n" * m[0].count("\n"), text)


def stripped_lines(text: Column, lang: Column) -> Column:
    """strip_text() of a column; as an expression it would be repeated for each language and use."""

    @F.pandas_udf("string")
    def run(text: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([strip_text(t, x) for t, x in zip(text, lang, strict=True)])

    return run(text, lang)


def code_identifiers(text: Column, lang: Column) -> Column:
    """Identifiers outside comments and strings, in order."""
    return F.regexp_extract_all(stripped(text, lang), F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))


def call_identifiers(text: Column, lang: Column) -> Column:
    """Identifiers in call position: followed by a parenthesis (a generic argument list may stand between in Rust)."""
    return F.regexp_extract_all(stripped(text, lang), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)(?=(?:::<[^()]*>)?[ \t]*\()"), F.lit(1))


def call_sites(text: Column, name: str) -> Column:
    return F.regexp_count(text, F.lit(rf"(?<![A-Za-z0-9_]){name}[ \t]*[(]"))
