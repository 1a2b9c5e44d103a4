"""Locators: PATH[#SYMBOL]@Lstart-end[ :: sha256=HEX], where the hash is of the symbol's own lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

PATTERN = r"^([^#@]+?)(?:#([^@]*))?@L([0-9]+)-([0-9]+)(?: :: [a-z0-9]+=([0-9a-f]+))?$"


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def slice_text(lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, inclusive) as one text."""
    return F.array_join(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), "\n")


def format_locator(path: Column, name: Column, start: Column, end: Column, digest: Column) -> Column:
    symbol = F.when(name.isNull() | (name == ""), "").otherwise(F.concat(F.lit("#"), name))
    return F.concat(path, symbol, F.lit("@L"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(" :: sha256="), digest)


def parse_locator(locator: Column) -> Column:
    """struct(path, symbol, start, end, hash), null if malformed."""
    part = lambda k: F.nullif(F.regexp_extract(locator, PATTERN, k), F.lit(""))
    fields = F.struct(part(1).alias("path"), part(2).alias("symbol"), part(3).cast("int").alias("start"), part(4).cast("int").alias("end"), part(5).alias("hash"))
    return F.when(locator.rlike(PATTERN), fields)


def parse_symbol_query(q: str) -> tuple[str | None, str]:
    """(path, name) of ``PATH#SYM@L… :: …``; a bare name has no path."""
    head = q.split(" :: ")[0]
    head = re.sub(r"@L\d+-\d+$", "", head.strip())
    path, cut, name = head.rpartition("#")
    return (path or None, name) if cut else (None, head)


def parse_line_range(spec: str, total: int) -> tuple[int, int]:
    """``a-b``, ``a``, ``a-``, ``-n`` and ``~n`` (the last n lines); a reversed range is an error before it is clamped."""
    spec = spec.strip()
    if m := re.fullmatch(r"[-~](\d+)", spec):
        return max(1, total - int(m[1]) + 1), total
    if not (m := re.fullmatch(r"(\d+)(?:(-)(\d*))?", spec)):
        raise ValueError(f"bad line range {spec!r}")
    a = int(m[1])
    b = int(m[3]) if m[3] else total if m[2] else a
    if a == 0 or m[3] and b < a:
        raise ValueError(f"bad line range {spec!r}")
    return min(a, total), max(min(b, total), min(a, total))


def register(spark: SparkSession) -> None:
    """SQL functions est_tokens, locator and in_glob for the session."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION est_tokens(t STRING) RETURNS BIGINT RETURN greatest(1, floor(octet_length(t) / 4))")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION locator(path STRING, name STRING, s INT, e INT, body STRING) RETURNS STRING "
        "RETURN concat(path, if(coalesce(name, '') = '', '', concat('#', name)), '@L', s, '-', e, ' :: sha256=', substr(sha2(body, 256), 1, 16))"
    )
