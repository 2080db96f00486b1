"""Queries over the graph on a relation whose few names join most of its files: none of them may build the edges, and all match their SQL."""

from __future__ import annotations

import os

import pytest

from tagloom.operators import graph
from tagloom.plans import registry

duckdb = pytest.importorskip("duckdb")


def sql(name: str, folder: str) -> list[tuple]:
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{folder}/{t}'")
    return con.sql(registry.ORACLE_SQL[name]).fetchall()


@pytest.fixture(scope="module")
def dense(tmp_path_factory) -> str:
    """``events`` of sf0.01 with two numbers in ``props`` instead of a hundred."""
    folder = str(tmp_path_factory.mktemp("dense"))
    duckdb.sql(f"""COPY (SELECT event_id, ts, user_id, event_type, value, '{{"k": ' || CASE WHEN event_id % 4 = 0 THEN 1 ELSE 17 END || '}}' AS props FROM '/root/testdata/sf0.01/events.parquet') TO '{folder}/events.parquet'""")
    return folder


def held_against_sql(spark, monkeypatch, folder: str, name: str) -> None:
    def edges(*_, **__):
        raise AssertionError("the query builds the edges")

    monkeypatch.setattr(graph, "edges", edges)
    got, want = ([tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in rows] for rows in (registry.QUERIES[name](spark, folder).collect(), sql(name, folder)))
    assert want and sorted(got) == sorted(want)


def test_f1_dependents(spark, monkeypatch, dense):
    held_against_sql(spark, monkeypatch, dense, "b3_dependents")


def test_f5_callers_keep_sets_as_rows(spark, monkeypatch, dense):
    from tagloom.operators import callers
    from tagloom.plans import adapters

    held_against_sql(spark, monkeypatch, dense, "ca9_callers_depth2")
    t = adapters.tags(spark, dense, spans=True, wide=True)
    plan = callers.ref_sites(t, None, spark.createDataFrame([("k5", "p/u1.py")], "name string, origin string"))._jdf.queryExecution().toString()
    assert "collect_set" not in plan and "1, unboundedfollowing" not in plan.lower()


def test_f5_other_modules_by_their_written_name(spark):
    from tagloom.operators import callers
    from tagloom.schema import TAG

    rows = [(f, 1, 2, "load", "function", "python", i) for i, f in enumerate(("m/a.py", "n/b.py", "o/a.py"))] + [("x.py", n, 0, "load", "ref", "python", 9 + n) for n in (1, 2, 3)] + [("n/b.py", 5, 0, "load", "ref", "python", 20)]
    lines = spark.createDataFrame([("x.py", 1, "b.load()"), ("x.py", 2, "a . load(b)"), ("x.py", 3, "load(b.load, b.load)"), ("n/b.py", 5, "load")], "rel_file string, line int, text string")
    for origin, want in (("m/a.py", {("x.py", 1): "elsewhere", ("x.py", 2): "shown", ("x.py", 3): "elsewhere", ("n/b.py", 5): "elsewhere"}), ("", dict.fromkeys([("x.py", 1), ("x.py", 2), ("x.py", 3), ("n/b.py", 5)], "shown"))):
        got = callers.ref_sites(spark.createDataFrame(rows, TAG), lines, spark.createDataFrame([("load", origin)], "name string, origin string")).collect()
        assert {(r["rel_file"], r["line"]): r["status"] for r in got} == want and len(got) == len(want)


def test_f9_walks_of_many_files_are_counted_as_bits(spark, monkeypatch, dense):
    from tagloom.operators import changes

    def rows(*_, **__):
        raise AssertionError("the query makes a row of each walk and file")

    monkeypatch.setattr(changes, "reach", rows, raising=False)
    held_against_sql(spark, monkeypatch, dense, "t5_changed_blast")


def test_f9_sizes_of_reach_match_a_plain_walk(spark, monkeypatch):
    import numpy as np

    from tagloom.operators import walks

    rng = np.random.default_rng(7)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 300, (450, 2)) if a != b} | {(a, 7) for a in range(20, 60)})
    edge = spark.createDataFrame([(f"f{a}", f"f{b}", 1.0) for a, b in pairs], "src string, dst string, weight double")
    seeds = spark.createDataFrame([(f"f{i}",) for i in range(0, 310, 2)], "rel_file string")
    back: dict = {}
    for a, b in pairs:
        back.setdefault(b, set()).add(a)
    want = {}
    for i in range(0, 310, 2):
        seen, front = {i}, {i}
        for _ in range(3):
            front = set().union(*[back.get(x, set()) for x in front]) - seen
            seen |= front
        want[f"f{i}"] = len(seen) - 1
    monkeypatch.setattr(walks, "CHUNK", 37)
    for most in (walks.MOST_LINKS, 0):
        got = walks.reach_sizes(edge, seeds, 3, most).collect()
        assert {r["rel_file"]: r["n"] for r in got} == want and len(got) == len(want)
    block = rng.integers(0, 2**63, (777, 3)).astype(np.uint64)
    assert (walks.tally(block) == np.unpackbits(block.view(np.uint8), axis=1, bitorder="little").sum(0)).all()


def test_f15_tags_are_dealt_out_once_by_their_number(spark, monkeypatch, dense):
    from tagloom.plans import adapters

    held_against_sql(spark, monkeypatch, dense, "x17_deduplicated")
    monkeypatch.setattr(adapters, "DEALT", 700)
    plan = registry.QUERIES["x17_deduplicated"](spark, dense)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(rel_file" in plan and ", 15), REPARTITION_BY_NUM" in plan


def test_f15_first_of_each_tag_and_all_of_markdown(spark):
    from tagloom.operators import cache
    from tagloom.schema import TAG

    rows = [("a", 1, 5, "f", "ref", "python", 3), ("a", 1, 4, "f", "ref", "python", 2), ("a", 1, 0, "f", "ref", "markdown", 1), ("a", 1, 0, "f", "ref", "markdown", 1), ("a", 2, 0, "f", "ref", "python", 4), ("b", 1, 9, "f", "ref", "go", 2), ("b", 1, 8, "f", "ref", "go", 2)]
    got = sorted(tuple(r) for r in cache.deduplicated(spark.createDataFrame(rows, TAG)).collect())
    assert got == sorted([rows[1], rows[2], rows[3], rows[4], rows[6]])


@pytest.mark.parametrize(("pairs", "at_once"), [(10**9, 10**6), (20_000, 10**6), (20_000, 50)])
def test_f10_pairs_are_not_dealt_out(spark, monkeypatch, dense, pairs, at_once):
    from tagloom.plans import adapters

    monkeypatch.setattr(graph, "AT_ONCE", at_once)
    out = graph.edges(adapters.tags(spark, dense), False, pairs)
    assert sorted(tuple(r) for r in out.collect()) == sorted(sql("g5_edges", dense))
    plan = out._jdf.queryExecution().executedPlan().toString()
    last = plan.index("MapInArrow")
    assert "Exchange" not in plan[:last] and "Aggregate" not in plan[:last]


@pytest.mark.parametrize("name", ["dc6_summary", "g8_pagerank", "m1_repo_map", "dc5_orphan_files", "b2_reach", "b4_blast_total", "g9_out_weight", "se1_se2_search_ranked", "se3_search_within_budget"])
def test_queries_over_the_graph_never_build_edges(spark, monkeypatch, dense, name):
    held_against_sql(spark, monkeypatch, dense, name)


def test_f13_directory_outline_of_one_fold(spark, monkeypatch, dense):
    monkeypatch.setattr(graph, "edges", None)
    rows = registry.QUERIES["ou3_directory_outline"](spark, dense).collect()
    assert rows and [r["rel_file"] for r in rows] == sorted(r["rel_file"] for r in rows)


def test_links_rank_and_weigh_as_edges_do(spark, dense):
    from tagloom.plans import adapters

    t = adapters.tags(spark, dense)
    links, edge = graph.links(t, False, True), graph.edges(t, False)
    weights = [{r["src"]: r["out_weight"] for r in graph.out_weight(g).collect()} for g in (links, edge)]
    assert weights[0] == weights[1] and weights[0]
    ranks = [{r["rel_file"]: r["rank"] for r in graph.pagerank(t.select("rel_file"), g, small=n).collect()} for g, n in ((links, graph.SMALL), (links, 0), (edge, 0))]
    assert len(ranks[0]) > 100 and all(r.keys() == ranks[0].keys() and all(abs(r[f] - ranks[0][f]) < 1e-12 for f in r) for r in ranks[1:])
