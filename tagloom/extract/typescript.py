"""TypeScript and JavaScript files by a scanner over tokens and brackets."""

from __future__ import annotations

from .lexer import Token, brackets, tokens

# Words that are never references.
KEYWORDS = frozenset("abstract as async await break case catch class const continue debugger declare default delete do else enum export extends false finally for from function get if implements import in instanceof interface is keyof let namespace new null of private protected public readonly return set static super switch this throw true try type typeof undefined var void while with yield".split())
_PRIMITIVE = frozenset("any boolean number string symbol unknown never object bigint".split())
_MODIFIERS = frozenset("public private protected static readonly abstract async get set override declare".split())


def _flattened(text: str) -> list[Token]:
    return tokens(text, regex=True)


def typescript_tags(text: str) -> list[tuple[int, int, str, str]]:
    toks = _flattened(text)
    match = brackets(toks)
    n = len(toks)
    defs: list[tuple[int, int, str, str]] = []
    skip: set[int] = set()
    functions: list[tuple[int, int]] = []
    classes: list[tuple[int, int]] = []
    t = lambda i: toks[i].text if 0 <= i < n else ""

    def name(i: int) -> bool:
        return 0 <= i < n and toks[i].kind == "name"

    def seek(i: int, what: str, stops=(";",)) -> int:
        while i < n and t(i) != what and t(i) not in stops:
            i = match[i] + 1 if t(i) in ("(", "[") and i in match else i + 1
        return i if t(i) == what else -1

    def statement_end(i: int) -> int:
        """Last token of a statement: its semicolon, or the token before a line that starts anew."""
        while i < n:
            if t(i) == ";":
                return i
            if t(i) in ("(", "[", "{") and i in match:
                i = match[i]
            nxt = i + 1
            if nxt >= n or t(nxt) == "}":
                return i
            if toks[nxt].line > toks[i].line and t(i) not in ("=", ",", "+", "=>", "|", "&", "(", "?", ":", "&&", "||") and t(nxt) not in (".", "?.", "+", "|", "&", "?", ":", "&&", "||", ",", "=>", "="):
                return i
            i = nxt
        return n - 1

    # functions first: their bodies decide what is local
    for i in range(n):
        if t(i) == "function" and toks[i].kind == "name":
            j = i + (2 if t(i + 1) == "*" else 1)
            paren = seek(j, "(", ("{", ";"))
            brace = seek(match.get(paren, n) + 1, "{") if paren >= 0 else -1
            if brace >= 0:
                functions.append((brace, match.get(brace, n)))
                if name(j) and t(i + 1) != "*" and t(j) not in KEYWORDS and (i == 0 or t(i - 1) in (";", "}", "{", "export", "default", "async", ")", "declare") or toks[i - 1].line < toks[i].line):
                    defs.append((toks[j].line, toks[match.get(brace, j)].line, t(j), "function"))
            if name(j):
                skip.add(j)
        elif t(i) == "=>":
            if t(i + 1) == "{":
                functions.append((i + 1, match.get(i + 1, n)))
            else:
                functions.append((i, statement_end(i + 1)))
        elif t(i) in ("class", "interface") and toks[i].kind == "name" and name(i + 1) and t(i - 1) != ".":
            brace = seek(i + 2, "{")
            if brace >= 0 and t(i + 1) not in KEYWORDS:
                skip.add(i + 1)
                abstract = t(i - 1) == "abstract"
                if not (t(i) == "class" and abstract):
                    defs.append((toks[i + 1].line, toks[match.get(brace, i)].line, t(i + 1), t(i)))
                if t(i) == "class":
                    classes.append((brace, match.get(brace, n)))
    for a, b in classes:
        i = a + 1
        while i < b:
            start = i
            while name(i) and t(i) in _MODIFIERS and t(i + 1) not in ("(", "=", ":", ";"):
                i += 1
            if t(i) == "@":
                i += 2
                if t(i) == "(":
                    i = match.get(i, i) + 1
                continue
            if name(i) or t(i) == "#":
                i += t(i) == "#"
                own = i
                j = i + 1
                if t(j) in ("?", "!"):
                    j += 1
                if t(j) == "<":
                    j = seek(j, "(", ("{", ";", "="))
                if t(j) == "(":
                    brace = seek(match.get(j, j) + 1, "{")
                    if brace >= 0 and brace < b:
                        functions.append((brace, match.get(brace, n)))
                        defs.append((toks[own].line, toks[match.get(brace, own)].line, t(own), "method"))
                        skip.add(own)
                        i = match.get(brace, brace) + 1
                        continue
                    skip.add(own)
                    i = statement_end(j) + 1
                    continue
                end = statement_end(j)
                defs.append((toks[own].line, toks[end].line, t(own), "variable"))
                skip.add(own)
                i = max(end + 1, own + 1)
                continue
            i = max(i + 1, start + 1)
    local = lambda i: any(x < i < y for x, y in functions)
    for i in range(n):
        if toks[i].kind != "name":
            continue
        if t(i) in ("const", "let", "var") and t(i - 1) != "." and (name(i + 1) or t(i + 1) in ("{", "[")):
            end = statement_end(i)
            j = i + 1
            while j <= end and j < n:
                if name(j) and t(j) not in KEYWORDS:
                    skip.add(j)
                    if not local(j):
                        defs.append((toks[j].line, toks[end].line, t(j), "variable"))
                    j += 1
                while j <= end and t(j) != ",":
                    j = match[j] + 1 if t(j) in ("(", "[", "{") and j in match else j + 1
                j += 1
        elif t(i) == "type" and name(i + 1) and t(i + 2) in ("=", "<") and t(i - 1) != ".":
            skip.add(i + 1)
            defs.append((toks[i + 1].line, toks[statement_end(i)].line, t(i + 1), "type"))
    return sorted(set(defs)) + _references(toks, match, skip)


def _references(toks, match, skip) -> list[tuple[int, int, str, str]]:
    out = []
    n = len(toks)
    stack: list[str] = []
    for i, tok in enumerate(toks):
        before = toks[i - 1].text if i else ""
        if tok.kind == "op" and tok.text in ("(", "[", "{"):
            prev = toks[i - 1] if i else None
            callee = prev is not None and (prev.kind == "name" and prev.text not in KEYWORDS - {"super", "this"} or prev.text in (")", "]", ">"))
            if tok.text == "(":
                params = i in match and match[i] + 1 < n and toks[match[i] + 1].text in ("=>", "{", ":") and (not callee or (i - 1) in skip)
                stack.append("parameters" if params else "call" if callee or before in ("super",) else "group")
            elif tok.text == "[":
                stack.append("index" if callee else "array")
            else:
                stack.append("object" if before in ("(", ",", "=", ":", "return", "[", "=>", "?") else "block")
            continue
        if tok.kind == "op" and tok.text in (")", "]", "}"):
            if stack:
                stack.pop()
            continue
        if tok.kind != "name" or tok.text in KEYWORDS or i in skip:
            continue
        after = toks[i + 1].text if i + 1 < n else ""
        inside = stack[-1] if stack else "top"
        typed = before == ":" and tok.text not in _PRIMITIVE and (inside in ("parameters", "block", "top") or after in (";", "=", "{", ")", ",", "|"))
        hit = (
            after == "(" or before in (".", "?.") or after in (".", "?.") or before == "new"
            or (inside == "call" and before in ("(", ",") and after in (")", ","))
            or (inside == "object" and before == ":" and after in (",", "}"))
            or (before == "=" and after != "=>" and tok.text not in _PRIMITIVE) or (inside == "array" and before in ("[", ",") and after in ("]", ","))
            or before == "return" or after == "[" or (inside == "index" and before == "[" and after == "]")
            or typed or (before in ("|", "<") and tok.text not in _PRIMITIVE and after in ("|", ">", ",", ";", "=", ")", "[", "<", "{"))
            or (after == "<" and before in (":", "|", "=", "<", ","))
        )
        if hit and after != "=>" and not (after == ":" and inside == "object"):
            out.append((tok.line, 0, tok.text, "ref"))
    return out
