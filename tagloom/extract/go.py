"""Go files by a scanner over tokens and brackets."""

from __future__ import annotations

from .lexer import brackets, tokens

# Keywords of the language.
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_BINARY = frozenset("+ - * / % == != < <= > >= && || | ^ <<".split())
_ENDS = frozenset([",", ")", "]", "}", ";", "\n"])


def go_tags(text: str) -> list[tuple[int, int, str, str]]:
    toks = tokens(text, newlines=True)
    match = brackets(toks)
    n = len(toks)
    defs: list[tuple[int, int, str, str]] = []
    skip: set[int] = set()
    inside_function: list[tuple[int, int]] = []
    t = lambda i: toks[i].text if 0 <= i < n else ""

    def name(i: int) -> bool:
        return 0 <= i < n and toks[i].kind == "name" and toks[i].text not in KEYWORDS

    def body_after(i: int) -> int:
        """The opening brace of a function whose parameters close before i, or -1."""
        while i < n and t(i) not in ("{", "\n", ";"):
            if t(i) in ("interface", "struct") and t(i + 1) == "{":
                i = match.get(i + 1, i + 1) + 1
                continue
            i = match[i] + 1 if t(i) in ("(", "[") and i in match else i + 1
        return i if t(i) == "{" else -1

    depth, i = 0, 0
    while i < n:
        x = t(i)
        if x == "func" and toks[i].kind == "name":
            j, kind = i + 1, "function"
            if t(j) == "(" and depth == 0 and name(match.get(j, n) + 1) and t(match[j] + 2) in ("(", "["):
                kind, j = "method", match[j] + 1
            if name(j) and depth == 0:
                k = j + 1
                if t(k) == "[":
                    k = match.get(k, k) + 1
                brace = body_after(match.get(k, k) + 1)
                end = match.get(brace, j) if brace >= 0 else match.get(k, k)
                defs.append((toks[j].line, toks[end].line, toks[j].text, kind))
                skip.add(j)
                if brace >= 0:
                    inside_function.append((brace, match.get(brace, n)))
            elif t(j) == "(":
                brace = body_after(match.get(j, j) + 1)
                if brace >= 0:
                    inside_function.append((brace, match.get(brace, n)))
        elif x in ("type", "var", "const") and toks[i].kind == "name":
            group = t(i + 1) == "("
            close = match.get(i + 1, n - 1) if group else None
            at = i + 2 if group else i + 1
            last = toks[close].line if group else 0
            local = any(a < i < b for a, b in inside_function)
            while at < n:
                while t(at) in ("\n", ";"):
                    at += 1
                if group and at >= close:
                    break
                stop = at
                while stop < n and t(stop) not in ("\n", ";") and not (group and stop >= close):
                    stop = match[stop] + 1 if t(stop) in ("(", "[", "{") and stop in match else stop + 1
                end = last or toks[min(stop, n) - 1].line
                if name(at):
                    if x == "type":
                        skip.add(at)
                        generic = t(at + 1) == "[" and name(at + 2) and t(at + 3) != "]"
                        alias = t(match.get(at + 1, at) + 1 if generic else at + 1) == "="
                        if not alias:
                            defs.append((toks[at].line, end, toks[at].text, "type"))
                    else:
                        k = at
                        while name(k):
                            skip.add(k)
                            if not local:
                                defs.append((toks[k].line, end, toks[k].text, "variable" if x == "var" else "constant"))
                            if t(k + 1) != ",":
                                break
                            k += 2
                at = stop + 1
                if not group:
                    break
        if x == "{":
            depth += 1
        elif x == "}":
            depth -= 1
        i += 1
    return sorted(defs) + _references(toks, match, skip)


def _kind_of_bracket(toks, open_: int) -> str:
    """What a '(' or '{' opens: call, parameters, literal, or block."""
    before = toks[open_ - 1] if open_ else None
    if before is None:
        return "block"
    if toks[open_].text == "(":
        callable_ = before.kind == "name" and before.text not in KEYWORDS or before.text in (")", "]")
        if callable_ and before.kind == "name" and open_ >= 2 and toks[open_ - 2].text == "func":
            return "parameters"
        return "call" if callable_ else "parameters" if before.text == "func" else "group"
    return "literal" if (before.kind == "name" and before.text not in KEYWORDS) or before.text in ("]", "}") else "block"


def _references(toks, match, skip) -> list[tuple[int, int, str, str]]:
    out = []
    n = len(toks)
    stack: list[tuple[str, int]] = []
    for i, tok in enumerate(toks):
        if tok.kind == "op" and tok.text in ("(", "[", "{"):
            stack.append((_kind_of_bracket(toks, i) if tok.text != "[" else "index", i))
            continue
        if tok.kind == "op" and tok.text in (")", "]", "}"):
            if stack:
                stack.pop()
            continue
        if tok.kind != "name" or tok.text in KEYWORDS or i in skip or tok.text == "_":
            continue
        before = toks[i - 1].text if i else "\n"
        after = toks[i + 1].text if i + 1 < n else "\n"
        inside = stack[-1][0] if stack else "top"
        hit = (
            after == "(" or before == "." or after == "."
            or (after == "{" and before in ("]", "&", "=", ":=", "(", ",", "return", "*", ":") )
            or (inside == "call" and before in ("(", ",") and after in (")", ",", "\n", "..."))
            or (inside == "literal" and before in ("{", ",", "\n", ":") and after in ("}", ",", "\n"))
            or (before in _BINARY and _operand(toks, i - 2)) or after in _BINARY - {"*"}
            or before in (":=", "=", "return", "+=", "-=") or after in ("=", "+=", "-=")
            or (before == "," and _in_list(toks, i))
            or before in ("*", "]", "map", "chan")
            or (before not in ("\n", "{", "(", ",", ";", "range", "if", "for", "switch", "case", "go", "defer", "!", "&", "-", "<-", "func", "package", "import", "goto", "break", "continue") and after in (",", ")", "\n", "{", "=", "}", "`") and toks[i - 1].kind == "name" and toks[i - 1].text not in KEYWORDS)
            or (before == ")" and after == "{") or (before == ")" and after == "\n")
        )
        if hit and not (after == ":=" or (after == ":" and inside == "literal")):
            out.append((tok.line, 0, tok.text, "ref"))
    return out


def _operand(toks, i: int) -> bool:
    return i >= 0 and (toks[i].kind in ("name", "number", "string") and toks[i].text not in KEYWORDS or toks[i].text in (")", "]"))


def _in_list(toks, i: int) -> bool:
    """Whether a comma list runs back to '=', ':=' or return on this line, or on to '='."""
    j = i - 1
    while j >= 0 and (toks[j].text == "," or toks[j].kind == "name" and toks[j].text not in KEYWORDS):
        j -= 1
    if j >= 0 and toks[j].text in ("=", ":=", "return"):
        return True
    k = i + 1
    while k < len(toks) and (toks[k].text == "," or toks[k].kind == "name"):
        k += 1
    return k < len(toks) and toks[k].text == "="
