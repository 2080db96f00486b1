"""Extractors: the text of one file to its tags (line, end_line, name, kind), in order of emission."""

from __future__ import annotations

from .go import go_tags
from .markdown import markdown_tags
from .python import python_tags
from .typescript import typescript_tags

EXTRACTORS = {"python": python_tags, "markdown": markdown_tags, "go": go_tags, "typescript": typescript_tags, "javascript": typescript_tags}


def extract(text: str, lang: str) -> list[tuple[int, int, str, str]]:
    """Tags of one text; none for an empty text, an unknown language or a text that does not parse."""
    run = EXTRACTORS.get(lang)
    if run is None or not text:
        return []
    try:
        tags = run(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    return tags if lang == "markdown" else list({(name, kind, line): (line, end, name, kind) for line, end, name, kind in reversed(tags)}.values())[::-1]
