"""Markdown: ATX headings, inline links and wikilinks."""

from __future__ import annotations

import re

_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_LINK = re.compile(r"(!?)\[((?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\(\s*<?([^)\s>]+)>?(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)")
_WIKI = re.compile(r"\[\[([^\]]+)\]\]")
_CODE = re.compile(r"(`+)(?:.|\n)*?\1")
_MARKS = re.compile(r"[*_`]|!?\[([^\]]*)\]\([^)]*\)")


def markdown_tags(text: str) -> list[tuple[int, int, str, str]]:
    out, fence = [], ""
    for number, line in enumerate(text.split("\n"), 1):
        line = line.rstrip("\r")
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line[mark.end() :].strip():
                fence = ""
            continue
        if mark:
            fence = mark[1]
            continue
        head = _HEADING.match(line)
        if head and (title := (head[2] or "").strip()):
            out.append((number, 0, title, f"heading-{len(head[1])}"))
        plain = _CODE.sub(lambda m: " " * len(m[0]), line)
        out += [(number, 0, m[3], "ref") for m in _LINK.finditer(plain) if not m[1]]
    for m in _WIKI.finditer(text):
        if name := m[1].strip():
            out.append((text.count("\n", 0, m.start()) + 1, 0, name, "ref"))
    return out
