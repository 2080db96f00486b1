"""Which paths of a tree are left out: fixed names first, then rule files, the last matching rule deciding."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from tagloom.functions.columns import IGNORED_DIRS, IGNORED_SUFFIXES

RULE_BYTES = 1 << 20


def glob(pattern: str) -> re.Pattern:
    """A file-name pattern: ``*`` and ``?`` stop at slashes, ``[...]`` is a set, ``\\`` escapes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (j := pattern.find("]", i + 2 if pattern[i + 1 : i + 2] in ("^", "]") else i + 1)) > 0:
            body = pattern[i + 1 : j].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[:1] == "^" else body) + "]"
            i = j
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    try:
        return re.compile(out + r"\Z")
    except re.error:
        return re.compile(r"(?!)")


def fits(pattern: str, path: str) -> bool:
    return glob(pattern).match(path) is not None


def fits_deep(pattern: str, path: str) -> bool:
    """Patterns with ``**``: any number of leading folders, or fragments in order."""
    if pattern.startswith("**/"):
        rest, parts = pattern[3:], path.split("/")
        tails = ["/".join(parts[i:]) for i in range(len(parts) + 1)]
        if "**" in rest:
            return any(fits_deep(rest, t) for t in tails)
        return any(fits(rest, t) or t.startswith(rest + "/") for t in tails)
    head, middle, tail = pattern.partition("/**/")
    if not middle:
        return fits(pattern, path)
    if path != head and not path.startswith(head + "/") and not fits(head, path):
        return False
    return fits_deep(tail, path.removeprefix(head + "/"))


@dataclass(frozen=True)
class Rule:
    scope: str
    raw: str
    negate: bool
    dir_only: bool

    @classmethod
    def parse(cls, line: str, scope: str = "") -> Rule | None:
        line = line.strip()
        if not line or line.startswith("#"):
            return None
        negate = line.startswith("!")
        line = line[1:] if negate else line
        dir_only = line.endswith("/")
        line = line[:-1] if dir_only else line
        return cls(scope, line.removeprefix("/"), negate, dir_only) if line else None

    def matches(self, path: str, is_dir: bool) -> bool:
        if self.dir_only and not is_dir:
            return False
        if self.scope and path != self.scope and not path.startswith(self.scope + "/"):
            return False
        sub = path.removeprefix(self.scope + "/") if self.scope else path
        if "**" in self.raw:
            return fits_deep(self.raw, sub)
        if "/" in self.raw:
            return fits(self.raw, sub) or sub.startswith(self.raw + "/")
        return any(fits(self.raw, part) for part in sub.split("/"))


class Ignore:
    """Rules in load order: the project's own ignore file, then every .gitignore with its folder as scope."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = rules

    @classmethod
    def of_tree(cls, root: str, own: str = ".tagloomignore") -> Ignore:
        rules: list[Rule] = []

        def load(path: str, scope: str) -> None:
            if os.path.isfile(path) and not os.path.islink(path) and os.path.getsize(path) <= RULE_BYTES:
                with open(path, encoding="utf-8", errors="replace") as f:
                    rules.extend(r for line in f if (r := Rule.parse(line, scope)))

        load(os.path.join(root, own), "")
        for folder, dirs, _ in os.walk(root):
            dirs[:] = sorted(d for d in dirs if d not in IGNORED_DIRS)
            rel = os.path.relpath(folder, root).replace(os.sep, "/")
            load(os.path.join(folder, ".gitignore"), "" if rel == "." else rel)
        return cls(rules)

    def __call__(self, path: str, is_dir: bool = False) -> bool:
        parts = path.split("/")
        if any(p in IGNORED_DIRS for p in parts) or (not is_dir and parts[-1].endswith(IGNORED_SUFFIXES)):
            return True
        out = False
        for rule in self.rules:
            if rule.matches(path, is_dir):
                out = not rule.negate
        return out
