"""JSON-RPC and command line over a session."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import MISSING, fields

from .model import DETAILS, MODES, ApplyRequest, Edit, Query, Request

VERSION = "0.2"
RESOURCES = ("repo-map", "status", "project", "help")


TYPES = {"str": "string", "int": "integer", "bool": "boolean"}


def schema_of(kind: type) -> dict:
    """The JSON schema of a request's fields."""
    out: dict = {"type": "object", "properties": {}, "required": []}
    for f in fields(kind):
        base = f.type.removesuffix(" | None")
        if base.startswith("tuple["):
            item = base[6:].split(",")[0]
            nested = {"Query": Query, "Edit": Edit}.get(item)
            out["properties"][f.name] = {"type": "array", "items": schema_of(nested) if nested else {"type": TYPES[item]}}
        else:
            out["properties"][f.name] = {"type": TYPES[base]}
        if f.default is MISSING and f.default_factory is MISSING:
            out["required"].append(f.name)
    if kind is Query:
        out["properties"]["mode"]["enum"], out["properties"]["detail"]["enum"] = list(MODES), list(DETAILS)
    return out


#: Tools and what they take.
TOOLS = {"code": Request, "code_apply": ApplyRequest}


def dispatch(session, message: dict) -> dict | None:
    """The answer to one request; notifications have none."""
    method, params, key = message.get("method", ""), message.get("params") or {}, message.get("id")
    try:
        if method == "initialize":
            result = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "textquarry", "version": VERSION}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [{"name": t, "inputSchema": schema_of(kind)} for t, kind in TOOLS.items()]}
        elif method == "tools/call":
            result = _call(session, params["name"], params.get("arguments") or {})
        elif method == "resources/list":
            result = {"resources": [{"uri": f"corpus://{r}"} for r in RESOURCES]}
        elif method == "resources/read":
            result = {"contents": [{"uri": params["uri"], "text": _resource(session, params["uri"].split("://")[-1])}]}
        elif key is None:
            return None
        else:
            return {"jsonrpc": "2.0", "id": key, "error": {"code": -32601, "message": f"unknown method {method}"}}
    except (ValueError, KeyError, PermissionError, TypeError) as e:
        return {"jsonrpc": "2.0", "id": key, "error": {"code": -32602, "message": str(e)}}
    return {"jsonrpc": "2.0", "id": key, "result": result}


def _call(session, name: str, arguments: dict) -> dict:
    if name == "code":
        text = session.code(arguments)
    elif name == "code_apply":
        text = json.dumps(session.apply(arguments))
    else:
        raise ValueError(f"unknown tool {name}")
    return {"content": [{"type": "text", "text": text}]}


def _resource(session, name: str) -> str:
    if name == "repo-map":
        return session.repo_map()
    if name in ("status", "project"):
        return json.dumps(getattr(session, name)())
    if name == "help":
        return session.status()["help"]
    raise ValueError(f"unknown resource {name}")


def main(args: list[str] | None = None) -> int:
    """query, map, status, project, apply, serve (JSON lines on standard input) over a directory; version."""
    from pyspark.sql import SparkSession

    from .session import Session

    p = argparse.ArgumentParser(prog="textquarry")
    p.add_argument("command", choices=("query", "map", "status", "project", "apply", "serve", "version"))
    p.add_argument("root", nargs="?", default=".")
    p.add_argument("request", nargs="?", default="")
    a = p.parse_args(args)
    if a.command == "version":
        print(VERSION)
        return 0
    session = Session.from_dir(SparkSession.builder.appName("textquarry").getOrCreate(), a.root)
    read = lambda: json.loads(a.request) if a.request[:1] in "{[" else a.request
    if a.command == "query":
        print(session.code(read()))
    elif a.command == "apply":
        print(json.dumps(session.apply(read()), indent=1))
    elif a.command == "serve":
        for line in sys.stdin:
            if (answer := dispatch(session, json.loads(line))) is not None:
                print(json.dumps(answer), flush=True)
    else:
        print({"map": session.repo_map, "status": lambda: json.dumps(session.status()), "project": lambda: json.dumps(session.project())}[a.command]())
    return 0
