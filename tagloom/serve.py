"""JSON-RPC over lines of text, and a command line: thin shims over ``Project``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from tagloom.project import Project

# Names, defaults and limits of the tools.
DEFAULT_TOOLS = ("repo_map", "search_identifiers", "get_blast_radius", "find_dead_code", "get_changed_symbols")
AGENT_TOOLS = ("callers", "outline", "search")
PROTOCOL = "2024-11-05"
MAX_DEPTH = 10
AGENT_MAP_TOKENS = 1024

_STRING, _INT, _BOOL = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}
_LIST = {"type": "array", "items": {"type": "string"}}
ARGUMENTS = {
    "repo_map": ({"map_tokens": _INT, "chat_files": _LIST, "force_refresh": _BOOL}, []),
    "search_identifiers": ({"query": _STRING, "filter": {"type": "string", "enum": ["defs", "refs", "both"]}, "limit": _INT, "kinds": _LIST}, ["query"]),
    "get_blast_radius": ({"symbol": _STRING, "max_depth": _INT, "file": _STRING, "full": _BOOL}, ["symbol"]),
    "find_dead_code": ({"kinds": _LIST, "min_rank": {"type": "number"}, **{k: _BOOL for k in ("include_test_symbols", "include_test_orphans", "include_doc_orphans", "unexported_only", "exported_only")}}, []),
    "get_changed_symbols": ({"diff": _STRING, "git_ref": _STRING, "include_blast_radius": _BOOL}, []),
    "callers": ({"symbol": _STRING, "file": _STRING, "depth": _INT, "context": _INT, "include_tests": _BOOL, "path": _STRING, "max_tokens": _INT}, ["symbol"]),
    "outline": ({"path": _STRING, "all": _BOOL, "include_tests": _BOOL, "max_tokens": _INT}, []),
    "search": ({"query": _STRING, "refs": _BOOL, "include_tests": _BOOL, "path": _STRING, "max_tokens": _INT}, ["query"]),
}


class BadArgument(ValueError):
    """Answered as -32602."""


def as_int(value, default: int = 0) -> int:
    """3, 3.0 and "3" alike; null is the default."""
    if value is None:
        return default
    try:
        return int(float(value)) if not isinstance(value, bool) else int(value)
    except (TypeError, ValueError) as e:
        raise BadArgument(f"not an integer: {value!r}") from e


def as_bool(value, default: bool = False) -> bool:
    """true, "true", 1, "1" and "yes" alike; null is the default."""
    if value is None:
        return default
    if isinstance(value, str):
        low = value.strip().lower()
        if low in ("true", "1", "yes"):
            return True
        if low in ("false", "0", "no", ""):
            return False
        raise BadArgument(f"not a boolean: {value!r}")
    if isinstance(value, (bool, int, float)):
        return bool(value)
    raise BadArgument(f"not a boolean: {value!r}")


def relative(path: str, root: str) -> str:
    """A path argument: absolute ones must lie within the root."""
    if not path or not os.path.isabs(path):
        return path or ""
    rel = os.path.relpath(path, root)
    if rel == ".." or rel.startswith("../"):
        raise BadArgument(f"{path} is outside the project")
    return "" if rel == "." else rel


def checked_root(asked: str | None, root: str) -> None:
    if asked and os.path.realpath(asked) != os.path.realpath(root):
        raise BadArgument("project_root is not the project this server answers for")


def selected(names: str = "", agent: bool = False) -> list[str]:
    """The tools to offer: all of the mode, or those listed."""
    known = [*DEFAULT_TOOLS, *(AGENT_TOOLS if agent else ())]
    asked = [n.strip() for n in names.split(",") if n.strip()]
    for n in asked:
        if n not in known:
            raise BadArgument(f"{n} needs --agent" if n in AGENT_TOOLS else f"unknown tool {n}; known: {', '.join(known)}")
    return asked or known


def tool_list(tools: list[str], agent: bool = False) -> list[dict]:
    out = []
    for name in tools:
        properties, required = ARGUMENTS[name]
        if not agent:
            properties = {"project_root": _STRING, **properties}
        out.append({"name": name, "description": (getattr(Project, name.removeprefix("get_"), Project.find_dead_code).__doc__ or name).strip().split("\n")[0], "inputSchema": {"type": "object", "properties": properties, **({"required": required} if required else {})}})
    return out


class Server:
    def __init__(self, project: Project, tools: list[str] | None = None, agent: bool = False) -> None:
        self.project, self.agent = project, agent
        self.tools = tools or selected(agent=agent)

    def call(self, name: str, a: dict) -> str:  # noqa: C901
        p, root = self.project, self.project.root
        if name not in self.tools:
            raise BadArgument(f"unknown tool {name}")
        checked_root(a.get("project_root"), root)
        path, file, tests = relative(a.get("path", ""), root), relative(a.get("file", ""), root), as_bool(a.get("include_tests"))
        most = as_int(a.get("max_tokens"))
        if name in ("get_blast_radius", "callers") and not a.get("symbol"):
            raise BadArgument("symbol is required")
        if name == "repo_map":
            asked = as_int(a.get("map_tokens"))
            return p.repo_map(asked if asked > 0 else AGENT_MAP_TOKENS if self.agent else 8192, a.get("chat_files"), as_bool(a.get("force_refresh")))
        if name == "search_identifiers":
            return p.search_identifiers(a.get("query", ""), a.get("filter") or "both", as_int(a.get("limit")), a.get("kinds"))
        if name == "get_blast_radius":
            if self.agent and not as_bool(a.get("full")):
                return p.callers(a["symbol"], file, as_int(a.get("max_depth")) or 2)
            return p.blast_radius(a["symbol"], min(as_int(a.get("max_depth")) or 3, MAX_DEPTH), file)
        if name == "find_dead_code":
            flags = {k: as_bool(a.get(k)) for k in ("include_test_symbols", "include_test_orphans", "include_doc_orphans", "unexported_only", "exported_only")}
            return json.dumps(_checked(p.find_dead_code, a.get("kinds"), float(a.get("min_rank") or 0), **flags))
        if name == "get_changed_symbols":
            return json.dumps(_checked(p.changed_symbols, a.get("diff", ""), a.get("git_ref", ""), as_bool(a.get("include_blast_radius"))))
        if name == "callers":
            return p.callers(a["symbol"], file, as_int(a.get("depth"), 1), as_int(a.get("context")), tests, path, most)
        if name == "outline":
            return p.outline(path, as_bool(a.get("all")), tests, most)
        return p.search(a.get("query", ""), as_bool(a.get("refs")), tests, path, most)

    def answer(self, request: dict) -> dict | None:
        method, number = request.get("method", ""), request.get("id")
        if number is None:
            return None  # a notification
        reply = {"jsonrpc": "2.0", "id": number}
        try:
            if method == "initialize":
                return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}, "prompts": {}}, "serverInfo": {"name": "tagloom", "version": "0.1.0"}}}
            if method == "ping":
                return reply | {"result": {}}
            if method == "tools/list":
                return reply | {"result": {"tools": tool_list(self.tools, self.agent)}}
            if method == "prompts/list":
                return reply | {"result": {"prompts": []}}
            if method == "tools/call":
                params = request.get("params") or {}
                return reply | {"result": {"content": [{"type": "text", "text": self.call(params.get("name", ""), params.get("arguments") or {})}]}}
            return reply | {"error": {"code": -32601, "message": f"method not found: {method}"}}
        except BadArgument as e:
            return reply | {"error": {"code": -32602, "message": str(e)}}
        except Exception as e:  # noqa: BLE001 - one request's failure must not end the session
            return reply | {"error": {"code": -32603, "message": str(e).split("\n")[0]}}

    def serve(self, source=sys.stdin, sink=sys.stdout) -> None:
        """One JSON request a line until the input ends; a line that is no JSON is answered and ends the session."""
        for line in source:
            if not line.strip():
                continue
            try:
                request = json.loads(line)
            except ValueError:
                print(json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}), file=sink, flush=True)
                return
            if (reply := self.answer(request)) is not None:
                print(json.dumps(reply), file=sink, flush=True)


def _checked(f, *args, **kwargs):
    try:
        return f(*args, **kwargs)
    except ValueError as e:
        raise BadArgument(str(e)) from e


class Catalog:
    """Projects by root, within allowed folders."""

    def __init__(self, spark, allowed: list[str] | None = None) -> None:
        self.spark, self.allowed = spark, [os.path.realpath(a) for a in allowed or []]
        self.projects: dict[str, Project] = {}

    def add(self, root: str) -> Project:
        real = os.path.realpath(root)
        if self.allowed and not any(real == a or real.startswith(a + os.sep) for a in self.allowed):
            raise PermissionError(f"{root} is not in an allowed folder")
        if real not in self.projects:
            self.projects[real] = Project.open(self.spark, real)
        return self.projects[real]

    def remove(self, root: str) -> bool:
        return self.projects.pop(os.path.realpath(root), None) is not None

    def status(self) -> dict:
        rows = [p.status() for _, p in sorted(self.projects.items())]
        return {"projects": rows, "total_tags": sum(r["tags"] for r in rows), "memory_bytes": sum(r["memory_bytes"] for r in rows)}


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    parser = argparse.ArgumentParser(prog="tagloom")
    parser.add_argument("root")
    parser.add_argument("--agent", action="store_true")
    parser.add_argument("--tools", default="")
    parser.add_argument("--cache", default="", help="folder of the tag cache, in any store Spark reads")
    args = parser.parse_args(argv)
    tools = selected(args.tools, args.agent)
    spark = SparkSession.builder.appName("tagloom").getOrCreate()
    Server(Project.open(spark, os.path.realpath(args.root), args.cache), tools, args.agent).serve()


if __name__ == "__main__":
    main()
