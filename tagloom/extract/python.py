"""Python files through the standard ``ast``."""

from __future__ import annotations

import ast
import warnings

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


class _Scope:
    """Names bound by one function: parameters and plain assignments; and those it declares as outer."""

    def __init__(self, node, outer: _Scope | None) -> None:
        self.outer = outer
        a = node.args
        self.bound = {p.arg for p in [*a.posonlyargs, *a.args, *a.kwonlyargs, *([a.vararg] if a.vararg else []), *([a.kwarg] if a.kwarg else [])]}
        self.globals: set[str] = set()
        self.nonlocals: set[str] = set()

    def hides(self, name: str) -> bool:
        scope: _Scope | None = self
        while scope is not None:
            if name in scope.globals:
                return False
            if name not in scope.nonlocals and name in scope.bound:
                return True
            scope = scope.outer
        return False


class _Walk:
    def __init__(self, lines: list[str]) -> None:
        self.lines = lines
        self.defs: list[tuple[int, int, str, str]] = []
        self.refs: list[tuple[int, str, _Scope | None]] = []

    def name_line(self, node) -> int:
        # ast gives the line of def or class; a name pushed to a later line by a continuation is rare and takes it as well
        return node.lineno

    def ref(self, name: str, line: int, scope) -> None:
        if name not in ("self", "cls"):
            self.refs.append((line, name, scope))

    def value(self, node, scope) -> None:
        """A position that counts as a reference if it is a bare name."""
        if isinstance(node, ast.Name):
            self.ref(node.id, node.lineno, scope)
        elif node is not None:
            self.visit(node, scope)

    def values(self, nodes, scope) -> None:
        for n in nodes:
            self.value(n, scope)

    def assign(self, target, scope, end: int, in_lambda: bool = False) -> None:
        if isinstance(target, ast.Name):
            if scope is not None:
                scope.bound.add(target.id)
            elif not in_lambda:
                self.defs.append((target.lineno, end or target.lineno, target.id, "variable"))
        else:
            self.visit(target, scope)

    def visit(self, node, scope, end: int = 0) -> None:  # noqa: C901
        """``end``: last line of the nearest class or function around, 0 at module level."""
        v = self.value
        if isinstance(node, _FUNCTIONS):
            self.defs.append((self.name_line(node), node.end_lineno, node.name, "function"))
            self.values(node.decorator_list, scope)
            inner = _Scope(node, scope)
            a = node.args
            self.values([d for d in [*a.defaults, *a.kw_defaults] if d is not None], inner)
            for p in [*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg]:
                if p is not None:
                    v(p.annotation, inner)
            v(node.returns, inner)
            for s in node.body:
                self.visit(s, inner, node.end_lineno)
        elif isinstance(node, ast.ClassDef):
            self.defs.append((self.name_line(node), node.end_lineno, node.name, "class"))
            self.values(node.decorator_list, scope)
            self.values([*node.bases, *node.keywords], scope)
            for s in node.body:
                self.visit(s, scope, node.end_lineno)
        elif isinstance(node, ast.Lambda):
            a = node.args
            self.values([d for d in [*a.defaults, *a.kw_defaults] if d is not None], scope)
            v(node.body, scope)
        elif isinstance(node, ast.Assign):
            for t in node.targets:
                self.assign(t, scope, end)
            v(node.value, scope)
        elif isinstance(node, ast.AnnAssign):
            self.assign(node.target, scope, end)
            v(node.annotation, scope)
            v(node.value, scope)
        elif isinstance(node, ast.AugAssign):
            if not isinstance(node.target, ast.Name):
                self.visit(node.target, scope)
            v(node.value, scope)
        elif isinstance(node, ast.Global):
            if scope is not None:
                scope.globals.update(node.names)
        elif isinstance(node, ast.Nonlocal):
            if scope is not None:
                scope.nonlocals.update(node.names)
        elif isinstance(node, ast.Attribute):
            v(node.value, scope)
            self.ref(node.attr, node.end_lineno, scope)
        elif isinstance(node, (ast.For, ast.AsyncFor)):
            if not isinstance(node.target, ast.Name):
                self.visit(node.target, scope)
            v(node.iter, scope)
            for s in [*node.body, *node.orelse]:
                self.visit(s, scope, end)
        elif isinstance(node, ast.comprehension):
            if not isinstance(node.target, ast.Name):
                self.visit(node.target, scope)
            v(node.iter, scope)
            self.values(node.ifs, scope)
        elif isinstance(node, ast.Expr):
            if not isinstance(node.value, ast.Name):
                self.visit(node.value, scope)
        elif isinstance(node, ast.NamedExpr):
            if not isinstance(node.value, ast.Name):
                self.visit(node.value, scope)
        elif isinstance(node, ast.Match):
            if not isinstance(node.subject, ast.Name):
                self.visit(node.subject, scope)
            for c in node.cases:
                v(c.guard, scope)
                for s in c.body:
                    self.visit(s, scope, end)
        elif isinstance(node, ast.withitem):
            v(node.context_expr, scope)
            if node.optional_vars is not None and not isinstance(node.optional_vars, ast.Name):
                self.visit(node.optional_vars, scope)
        elif isinstance(node, ast.ExceptHandler):
            v(node.type, scope)
            for s in node.body:
                self.visit(s, scope, end)
        elif isinstance(node, (ast.Tuple, ast.List)) and isinstance(node.ctx, ast.Store):
            for e in node.elts:
                if not isinstance(e, ast.Name):
                    self.visit(e, scope)
        elif isinstance(node, ast.Starred) and isinstance(getattr(node, "ctx", None), ast.Store):
            if not isinstance(node.value, ast.Name):
                self.visit(node.value, scope)
        elif isinstance(node, (ast.Import, ast.ImportFrom, ast.Name, ast.Constant)):
            return
        else:
            for child in ast.iter_child_nodes(node):
                if isinstance(child, ast.expr):
                    v(child, scope)
                else:
                    self.visit(child, scope, end if isinstance(child, ast.stmt) else 0)


def python_tags(text: str) -> list[tuple[int, int, str, str]]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    walk = _Walk(text.split("\n"))
    for s in tree.body:
        walk.visit(s, None)
    out = sorted(walk.defs, key=lambda d: d[0])
    return out + [(line, 0, name, "ref") for line, name, scope in walk.refs if scope is None or not scope.hides(name)]
