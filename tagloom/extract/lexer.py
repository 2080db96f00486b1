"""Tokens of C-like languages, with matching brackets."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, number, string, op
    text: str
    line: int


_TOKEN = re.compile(
    r"(?P<space>[ \t\r\f\v]+)|(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<newline>\n)"
    r"|(?P<name>[A-Za-z_$\u0080-￿][\w$]*)|(?P<number>\d[\w.]*)"
    r"|(?P<string>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?)"
    r"|(?P<op>\.\.\.|=>|:=|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\?\.|<-|\+\+|--|[-+*/%&|^]=|.)",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BEFORE_REGEX = {"(", ",", "=", ":", "[", "!", "&&", "||", "?", "{", "}", ";", "=>", "return", "", "\n"}


def tokens(text: str, newlines: bool = False, regex: bool = False) -> list[Token]:
    out, at, line, n = [], 0, 1, len(text)
    while at < n:
        if regex and text[at] == "/" and (out[-1].text if out else "") in _BEFORE_REGEX and (m := _REGEX.match(text, at)):
            out.append(Token("string", m[0], line))
            at = m.end()
            continue
        m = _TOKEN.match(text, at)
        kind, body = m.lastgroup, m[0]
        if kind == "newline":
            if newlines:
                out.append(Token("op", "\n", line))
        elif kind not in ("space", "line", "block"):
            out.append(Token(kind, body, line))
        line += body.count("\n")
        at = m.end()
    return out


_OPEN = {"(": ")", "[": "]", "{": "}"}


def brackets(toks: list[Token]) -> dict[int, int]:
    """Index of the closing token of each opening one, and the reverse."""
    out, stack = {}, []
    for i, t in enumerate(toks):
        if t.kind == "op" and t.text in _OPEN:
            stack.append(i)
        elif t.kind == "op" and t.text in _OPEN.values() and stack:
            j = stack.pop()
            out[i], out[j] = j, i
    for i in stack:
        out[i] = len(toks) - 1
    return out
