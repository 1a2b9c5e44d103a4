"""Requests: what a caller may ask for, and how loosely written ones are read."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields

MODES = ("auto", "lexical", "structural", "graph", "semantic", "ast", "diagnose")
DETAILS = ("locate", "outline", "snippet", "full", "refs", "impact", "context", "callgraph", "count", "tree", "diff", "ast", "import", "help")


@dataclass(frozen=True)
class Query:
    q: str = ""
    path: str | None = None
    mode: str = "auto"
    detail: str = "snippet"
    path_scope: tuple[str, ...] = ()
    lang: str | None = None
    lines: str | None = None
    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    k: int = 8

    def __post_init__(self):
        if self.mode not in MODES or self.detail not in DETAILS:
            raise ValueError(f"unknown mode or detail: {self.mode}, {self.detail}")

    @classmethod
    def of(cls, x) -> Query:
        """A query from itself, a bare string, or a mapping."""
        if isinstance(x, Query):
            return x
        if isinstance(x, str):
            return cls(q=x)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in x.items() if v is not None})


@dataclass(frozen=True)
class Request:
    queries: tuple[Query, ...]
    budget_tokens: int = 8000
    exclude_seen: bool = False

    @classmethod
    def of(cls, x) -> Request:
        if isinstance(x, Request):
            return x
        if isinstance(x, Mapping) and "queries" in x:
            return cls(tuple(map(Query.of, x["queries"])), x.get("budget_tokens", 8000), x.get("exclude_seen", False))
        return cls(tuple(map(Query.of, x)) if isinstance(x, list | tuple) else (Query.of(x),))


@dataclass(frozen=True)
class Edit:
    locator: str
    anchor: str | None = None
    replace: str | None = None
    new_body: str | None = None
    lazy_edit: str | None = None
    rename: str | None = None
    move_to: str | None = None
    word: bool = False
    path_scope: tuple[str, ...] = ()
    force: bool = False

    @classmethod
    def of(cls, x) -> Edit:
        known = {f.name for f in fields(cls)}
        return x if isinstance(x, Edit) else cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in x.items() if k in known})


@dataclass(frozen=True)
class ApplyRequest:
    edits: tuple[Edit, ...] = field(default_factory=tuple)
    dry_run: bool = False
    undo: int | None = None
    run: str | None = None

    @classmethod
    def of(cls, x) -> ApplyRequest:
        if isinstance(x, ApplyRequest):
            return x
        if isinstance(x, Mapping) and not {"edits", "undo", "run"} & set(x):
            x = {"edits": [x]}
        x = {"edits": x} if isinstance(x, list | tuple) else dict(x)
        return cls(tuple(map(Edit.of, x.get("edits", ()))), x.get("dry_run", False), x.get("undo"), x.get("run"))
