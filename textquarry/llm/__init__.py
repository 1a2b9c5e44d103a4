"""Training-data operators: every module holds one operator and its registered query.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()``
collect what ``__spark_entry__.py`` registers.
"""

from __future__ import annotations

import importlib

#: Module of each operator, in the order of their numbers.
MODULES = (
    "mixing",
    "decontaminate",
    "secrets",
    "quality",
    "exact_dedup",
    "jaccard_join",
    "html_extract",
    "suffix_dedup",
    "lm_score",
    "langid",
)


def queries() -> dict:
    out = {}
    for name in MODULES:
        out |= importlib.import_module(f"{__name__}.{name}").QUERIES
    return out


def oracle_sql() -> dict:
    out = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__name__}.{name}"), "ORACLE_SQL", {})
    return out
