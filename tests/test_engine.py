"""Operators against hand-made relations."""

from __future__ import annotations

import pytest

from tagloom.extract import extract
from tagloom.functions import columns as C
from tagloom.operators import callers, changes, deadcode, graph, outline, search
from tagloom.project import estimate
from tagloom.schema import TAG
from tagloom.sources.ignore import Ignore, Rule


def tags(spark, rows):
    full = [(f, line, end, name, kind, lang, i) for i, (f, line, end, name, kind, lang) in enumerate(rows)]
    return spark.createDataFrame(full, TAG)


def one(spark, expression, **values):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return frame.select(expression(*[F.col(k) for k in values]).alias("x")).first()["x"]


@pytest.mark.parametrize(("head", "lang"), [("#!/usr/bin/python3\n", "python"), ("#!/usr/bin/env -S python3.12 -u", "python"), ("#!/usr/bin/env A=1 node20", "javascript"), ("#!/usr/bin/env deno", "typescript"), ("#!/bin/sh", ""), ("", ""), ("#!", "")])
def test_shebang(spark, head, lang):
    assert one(spark, C.shebang_lang, h=head) == lang


@pytest.mark.parametrize(("path", "what"), [("a/test_x.py", "test"), ("a/x_test.go", "test"), ("test/x.py", "test"), ("internal/test/util/x.go", "source"), ("spec/a.py", "source"), ("a\\tests\\b.py", "test"), ("tests", "test"), ("README.md", "docs"), ("a/b.spec.tsx", "test"), ("conftest.py", "test")])
def test_category(spark, path, what):
    assert one(spark, C.category, p=path) == what


@pytest.mark.parametrize(("text", "want"), [("Architecture Overview", "architecture-overview"), ("Hello, World!", "hello-world"), ("API v2.0", "api-v20"), ("  Trimmed  ", "--trimmed--")])
def test_slug(spark, text, want):
    assert one(spark, C.slug, t=text) == want


def test_clip_and_tokens(spark):
    assert one(spark, C.clip, t="  a\tb  ") == "a b"
    assert one(spark, C.clip, t="x" * 200) == "x" * 160 + "…"
    for text in ("", "a1b22", "é" * 7, "word " * 50):
        assert one(spark, C.estimate_tokens, t=text) == estimate(text)


def test_links(spark):
    files = ["a/one.md", "b/Two.md", "c/two.md", "d.md"]
    links = [("a/one.md", "../d.md#x", "d.md"), ("a/one.md", "[[two|alias]]", "b/Two.md"), ("a/one.md", "https://x.y", None), ("a/one.md", "#frag", None), ("a/one.md", "p.png", None), ("a/one.md", "../../up.md", None), ("a/one.md", "/abs.md", "a/abs.md"), ("d.md", "none", None), ("d.md", "mailto:x@y", None)]
    f = spark.createDataFrame([(x,) for x in files], "rel_file string")
    got = graph.resolve_links(spark.createDataFrame([x[:2] for x in links], "rel_file string, name string"), f).collect()
    assert sorted((r["rel_file"], r["name"], r["target"]) for r in got if True) == sorted(links, key=lambda x: x[:2])


def test_edges_shadowing_and_markdown(spark):
    rows = [(f, 1, 1, "log", "function", "python") for f in ("a.py", "b.py", "c.py")] + [(f, 2, 0, "log", "ref", "python") for f in ("a.py", "b.py", "c.py")]
    assert graph.edges(tags(spark, rows)).count() == 0
    rows += [("c.py", 3, 0, "helper2", "ref", "python"), ("d.py", 1, 2, "helper2", "function", "python"), ("x.md", 1, 0, "Top", "heading-1", "markdown"), ("y.md", 2, 0, "x.md", "ref", "markdown"), ("y.md", 1, 0, "Top", "heading-1", "markdown")]
    got = {(r["src"], r["dst"], r["weight"]) for r in graph.edges(tags(spark, rows)).collect()}
    assert got == {("c.py", "d.py", 1.0), ("y.md", "x.md", 1.0)}


def test_pagerank_matches_a_plain_loop(spark):
    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("d", "a", 3.0), ("c", "a", 1.0)]
    nodes = list("abcdef")
    rank = dict.fromkeys(nodes, 1 / 6)
    for _ in range(15):
        out = {n: sum(w for s, _, w in edges if s == n) for n in nodes}
        lost = sum(rank[n] for n in nodes if not out[n])
        rank = {n: 0.15 / 6 + 0.85 * lost / 6 + 0.85 * sum(rank[s] * w / out[s] for s, d, w in edges if d == n) for n in nodes}
    got = {r["rel_file"]: r["rank"] for r in graph.pagerank(spark.createDataFrame([(n,) for n in nodes], "rel_file string"), spark.createDataFrame(edges, "src string, dst string, weight double")).collect()}
    assert got == pytest.approx(rank) and sum(got.values()) == pytest.approx(1)
    none = spark.createDataFrame([], "rel_file string")
    assert graph.pagerank(none, spark.createDataFrame([], "src string, dst string, weight double")).count() == 0


def test_reach_takes_least_depth(spark):
    edge = spark.createDataFrame([("b", "a", 1.0), ("c", "b", 1.0), ("c", "a", 1.0), ("d", "c", 1.0), ("a", "d", 1.0)], "src string, dst string, weight double")
    got = {(r["rel_file"], r["depth"]) for r in graph.reach(edge, spark.createDataFrame([("a",)], "rel_file string"), 3).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}


@pytest.mark.parametrize(
    ("spans", "hunks", "want"),
    [
        ([("f", 1, 4)], [(3, 3)], {("f", "body")}),
        ([("f", 1, 4)], [(1, 1)], {("f", "definition")}),
        ([("K", 1, 5), ("m", 2, 4)], [(3, 3)], {("m", "body")}),
        ([("K", 1, 5), ("m", 2, 4)], [(1, 1), (3, 3)], {("K", "definition"), ("m", "body")}),
        ([("K", 1, 9), ("m", 2, 4)], [(3, 3), (8, 8)], {("K", "body"), ("m", "body")}),
        ([("f", 1, 3), ("g", 10, 12)], [(7, 8)], set()),
        ([("f", 4, 0)], [(4, 5)], {("f", "definition")}),
    ],
)
def test_changed_symbols(spark, spans, hunks, want):
    t = tags(spark, [("a.py", line, end, name, "class" if name == "K" else "function", "python") for name, line, end in spans])
    h = spark.createDataFrame([("a.py", *x) for x in hunks], "file string, start int, end int")
    got = changes.changed_symbols(t, h)
    assert {(r["symbol"], r["reason"]) for r in got.collect()} == want
    n, b = len(want), sum(r == "body" for _, r in want)
    assert changes.summary(got, h).first()["summary"] == f"{n} changed symbols across 1 files" + (f" ({b} attributed to enclosing definitions)" if b else "")


def test_parse_diff(spark):
    text = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\tnow\n@@ -1,3 +1,2 @@ def\n+a\n@@ -10,2 +9 @@\n@@ -4 +6,0 @@\ndiff --git a/y b/y\n@@ -1 +1 @@\n+++ /dev/null\n@@ -1 +1 @@\n"
    got = {tuple(r) for r in changes.parse_diff(spark.createDataFrame([(text,)], "diff string")).collect()}
    assert got == {("x.py", 1, 2), ("x.py", 9, 9), ("x.py", 6, 6)}


def test_dead_code_flags(spark):
    t = tags(spark, [("a.py", 1, 1, "_helper", "function", "python"), ("a.py", 2, 2, "helper", "function", "python"), ("tests/b.py", 1, 1, "t", "function", "python"), ("a.py", 3, 3, "used", "function", "python"), ("c.py", 1, 0, "used", "ref", "python")])
    names = lambda **k: {r["name"] for r in deadcode.dead_symbols(t, **k).collect()}
    assert names() == {"_helper", "helper"} and names(unexported_only=True) == {"_helper"} and names(include_tests=True) == {"_helper", "helper", "t"}
    assert names(unexported_only=True, exported_only=True) == set() and names(kinds=["class", ""]) == set()
    assert deadcode.hidden_tests(t).first()["hidden_tests"] == 1


def test_enclosing_scope(spark):
    t = tags(spark, [("a.py", 1, 9, "K", "class", "python"), ("a.py", 2, 5, "m", "function", "python"), ("a.py", 3, 4, "inner", "function", "python"), ("a.py", 20, 21, "f", "function", "python")])
    sites = spark.createDataFrame([("a.py", n) for n in (1, 3, 5, 8, 15, 20)], "rel_file string, line int")
    got = {r["line"]: r["scope"] for r in callers.enclosing(sites, t).collect()}
    assert got == {1: "K", 3: "K.inner", 5: "K.m", 8: "K", 15: None, 20: "f"}


def test_sites_of_a_name_defined_twice(spark):
    t = tags(spark, [("a.py", 1, 2, "load", "function", "python"), ("b.py", 1, 2, "load", "function", "python"), ("b.py", 3, 0, "load", "ref", "python"), ("c.py", 1, 0, "load", "ref", "python"), ("d.py", 1, 0, "load", "ref", "python"), ("test_c.py", 1, 0, "load", "ref", "python")])
    lines = spark.createDataFrame([("c.py", 1, "b.load()"), ("d.py", 1, "a . load()"), ("b.py", 3, "load()")], "rel_file string, line int, text string")
    rows = callers.callers(t, lines, "load", file="a.py").collect()
    assert {(r["rel_file"], r["status"]) for r in rows} == {("b.py", "elsewhere"), ("c.py", "elsewhere"), ("d.py", "shown"), ("test_c.py", "test")}


def test_outline_depth_and_greedy_choice(spark):
    t = tags(spark, [("a.py", 1, 9, "K", "class", "python"), ("a.py", 2, 4, "m", "method", "python"), ("a.py", 3, 3, "v", "variable", "python"), ("a.py", 12, 12, "g", "function", "python")])
    assert [(r["name"], r["depth"]) for r in outline.file_outline(t).orderBy("line").collect()] == [("K", 0), ("m", 1), ("g", 0)]
    assert [r["name"] for r in outline.top_level(t).orderBy("place").collect()] == ["K", "g"]
    entries = spark.createDataFrame([("big", "x" * 400), ("small", "y" * 32), ("tiny", "z" * 16), ("none", "w" * 4000)], "rel_file string, entry string")
    ranks = spark.createDataFrame([("big", 0.9), ("small", 0.5), ("tiny", 0.1), ("none", 1.0)], "rel_file string, rank double")
    got = [r["rel_file"] for r in outline.chosen(entries, ranks, 10, 90, 60).collect()]
    assert got == ["small", "tiny"]


def test_search_order_and_budget(spark):
    t = tags(spark, [("a.py", 1, 1, "preload", "function", "python"), ("b.py", 1, 1, "load", "function", "python"), ("a.py", 2, 2, "load_all", "function", "python"), ("a.py", 3, 0, "load", "ref", "python"), ("tests/t.py", 1, 1, "load", "function", "python")])
    ranks = spark.createDataFrame([("a.py", 0.9), ("b.py", 0.1)], "rel_file string, rank double")
    hits = search.search(t, ranks, " LOAD ", refs=True)
    assert [r["name"] for r in hits.orderBy("place").collect()] == ["load", "load", "load_all", "preload"]
    assert search.within_budget(search.search_entries(hits), "place", 0, 55, 40).count() == 2


def test_ignore_rules():
    ig = Ignore([r for line in ("*.log", "!keep.log", "/build/x", "docs/", "**/gen/*.py", "a/**/z") if (r := Rule.parse(line))])
    assert ig("x/a.log") and not ig("keep.log") and ig("node_modules/q.js") and ig("b/gen/x.py") and ig("a/m/n/z") is False
    assert ig("a/z") and ig("docs", True) and not ig("docs") and ig("m.d.ts") and not ig("src/main.py")


PY = '''import os
X = 1
class A(Base):
    y: int = DEF
    def f(self, p, q=Z):
        loc = X
        for i in items:
            print(loc, i, p, g)
        return self.h(p)
@deco
async def g(a: T) -> R:
    global X
    X = 2
    return [k for k in src if k > lim]
'''


def test_python_tags():
    got = extract(PY, "python")
    assert [(n, k, line, end) for line, end, n, k in got if k != "ref"] == [("X", "variable", 2, 2), ("A", "class", 3, 9), ("y", "variable", 4, 9), ("f", "function", 5, 9), ("g", "function", 11, 14)]
    refs = {n for _, _, n, k in got if k == "ref"}
    assert {"Base", "int", "DEF", "Z", "X", "items", "print", "i", "g", "h", "deco", "T", "R", "src", "k", "lim"} == refs
    assert extract("def f(:", "python") == []


def test_go_typescript_and_markdown_tags():
    go = extract("package m\n\ntype T struct {\n\tF *Cfg\n}\n\nvar V = make1(x)\n\nfunc (t *T) Run(n N) error {\n\tvar local = 1\n\treturn t.helper(n)\n}\n", "go")
    assert {(n, k, line, end) for line, end, n, k in go if k != "ref"} == {("T", "type", 3, 5), ("V", "variable", 7, 7), ("Run", "method", 9, 12)}
    assert {"Cfg", "make1", "x", "N", "helper", "t", "n"} <= {n for _, _, n, k in go if k == "ref"}
    ts = extract("export interface S { a: number }\ntype I = Other;\nclass B {\n  size: W = first;\n  area() { const q = calc(this.w); return q; }\n}\nconst make = () => {\n  const inner = 1;\n};\nfunction top(x: Foo<Bar>) { return helper(x); }\n", "typescript")
    assert {(n, k) for _, _, n, k in ts if k != "ref"} == {("S", "interface"), ("I", "type"), ("B", "class"), ("size", "variable"), ("area", "method"), ("make", "variable"), ("top", "function")}
    assert {"Other", "W", "first", "calc", "Foo", "Bar", "helper", "x"} <= {n for _, _, n, k in ts if k == "ref"}
    md = extract("# Top\n\n```\n# no\n```\n## Sub ##\n[t](a/b.md) ![i](x.png) [[W]]\n", "markdown")
    assert [(n, k, line) for line, _, n, k in md] == [("Top", "heading-1", 1), ("Sub", "heading-2", 6), ("a/b.md", "ref", 7), ("W", "ref", 7)]


def registered(spark, tmp_path, name, texts):
    """Rows of a query on documents of these texts; those of its SQL must be the same."""
    import duckdb

    from tagloom.plans import registry

    path = f"{tmp_path}/documents.parquet"
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    docs.coalesce(1).write.parquet(path)
    got = sorted(tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert got == sorted(con.execute(registry.ORACLE_SQL[name]).fetchall())
    return got


def test_g1_slug_of_whole_texts(spark, tmp_path):
    assert registered(spark, tmp_path, "g1_slugify", ["A b" * 100, "Short é"]) == [(0, "a-b" * 100), (1, "short-")]


def test_ca5_text_sites_with_other_languages(spark, tmp_path):
    from tagloom.plans import adapters

    texts = ["é token\nno\n\u3000token\tß\u00a0", "token " + "x" * 153 + "€uro", "token " + "x" * 152 + "😀", "token " + "é" * 77 + "é"]
    tags, adapters.tags = adapters.tags, lambda spark, sf_dir: spark.createDataFrame([], "rel_file string")  # the query takes none of them
    try:
        got = registered(spark, tmp_path, "ca5_ca6_text_sites", texts)
    finally:
        adapters.tags = tags
    assert got == [("a/0.txt", 1, "é token"), ("a/0.txt", 3, "token ß"), ("a/1.txt", 1, "token " + "x" * 153 + "\ufffd…"), ("a/2.txt", 1, "token " + "x" * 152 + "\ufffd…"), ("a/3.txt", 1, "token " + "é" * 77 + "…")]


def test_ca11_context_of_every_line(spark, tmp_path):
    got = registered(spark, tmp_path, "ca11_context", ["a\nb\nc\nd", "one"])
    assert [(f, s, n) for f, s, n, m in got if m == " "] == [("a/0.txt", 1, 2), ("a/0.txt", 2, 1), ("a/0.txt", 2, 3), ("a/0.txt", 3, 2), ("a/0.txt", 3, 4), ("a/0.txt", 4, 3)]
    assert [(f, s, n) for f, s, n, m in got if m == ">"] == [("a/0.txt", n, n) for n in (1, 2, 3, 4)] + [("a/1.txt", 1, 1)]


def test_pagerank_in_one_task_and_in_rounds_agree(spark):
    from tagloom.operators import graph

    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "rel_file string")
    edge = spark.createDataFrame([("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 3.0), ("d", "a", 1.0)], "src string, dst string, weight double")
    one, many = ({r["rel_file"]: r["rank"] for r in graph.pagerank(nodes, edge, small=s).collect()} for s in (100, 0))
    assert set(one) == set("abcdef") and abs(sum(one.values()) - 1) < 1e-12
    assert all(abs(one[x] - many[x]) < 1e-12 for x in one) and one["a"] > one["e"] == one["f"]
