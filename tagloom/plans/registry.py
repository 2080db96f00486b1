"""Registered queries over the test tables and the SQL that states what each one returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import columns as C
from tagloom.operators import blast, cache, callers, changes, deadcode, graph, outline, search
from tagloom.scratch import discard
from tagloom.streaming import sessions

from . import adapters as A

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, *parts: str):
    """Register a function under its own name, with ``sql`` after the common table expressions ``parts``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = ("WITH " + ",".join(p.strip() for p in parts) + "\n" if parts else "") + sql.strip()
        return f

    return add


# Fixed values for the SQL side: the same vocabulary as the column functions.
_LANG = """CASE WHEN lower(b) LIKE '%.pb.go' OR lower(b) = '.env' OR starts_with(lower(b), '.env.') THEN ''
 WHEN x IN ('.md', '.markdown') THEN 'markdown' WHEN x IN ('.ts', '.tsx') THEN 'typescript' WHEN x IN ('.js', '.jsx', '.mjs') THEN 'javascript'
 WHEN x = '.go' THEN 'go' WHEN x = '.py' THEN 'python' WHEN x = '.rs' THEN 'rust' WHEN x = '.java' THEN 'java' WHEN x IN ('.c', '.h') THEN 'c'
 WHEN x IN ('.cpp', '.cc', '.hpp') THEN 'cpp' ELSE '' END"""
_SPLIT = r"""pb AS (SELECT *, string_split(path, '/')[-1] AS b, lower(regexp_extract(path, '(\.[^./]*)$', 1)) AS x FROM paths)"""
_TEST = r"""(regexp_matches(tb, '^test_.*\.py$') OR regexp_matches(tb, '(_test\.(py|go)|\.(test|spec)\.(js|jsx|ts|tsx))$') OR tb = 'conftest.py'
 OR len(list_intersect(ts, ['tests', '__tests__', 'testdata'])) > 0 OR (len(ts) >= 2 AND ts[-2] = 'test'))"""


def _test_of(column: str) -> str:
    p = f"replace({column}, '\\', '/')"
    return "(" + _TEST.replace("tb", f"string_split({p}, '/')[-1]").replace("ts,", f"string_split({p}, '/'),").replace("len(ts)", f"len(string_split({p}, '/'))").replace("ts[-2]", f"string_split({p}, '/')[-2]") + ")"


_CATEGORY = f"CASE WHEN regexp_matches(lower({{0}}), '\\.(md|markdown)$') THEN 'docs' WHEN {_test_of('{0}')} THEN 'test' ELSE 'source' END"


def _category(column: str) -> str:
    return _CATEGORY.replace("{0}", column)


# ---------------------------------------------------------------- scalar functions


@query(f"SELECT event_id, {_LANG} AS lang FROM pb", A.PATHS, _SPLIT)
def x1_lang_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.paths(spark, sf_dir).select("event_id", C.lang_of(F.col("path")).alias("lang"))


@query(f"SELECT event_id, ({_LANG}) <> '' OR (NOT contains(b, '.')) AS maybe FROM pb", A.PATHS, _SPLIT)
def x2_maybe_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.paths(spark, sf_dir).select("event_id", C.maybe_source(F.col("path")).alias("maybe"))


_HEADS = ["#!/usr/bin/python3\n", "#!/usr/bin/env python3.12 -u\n", "#!/usr/bin/env -S A=b node20\nx", "#!/bin/sh\n", "#! /opt/pypy3.9\n", "# no\n", "#!/usr/bin/env deno run", "#!ts-node", "#!\n", "#!/usr/bin/env -i\n"]


@query(
    """SELECT event_id, CASE WHEN n IN ('python', 'pypy') THEN 'python' WHEN n IN ('node', 'nodejs', 'bun') THEN 'javascript' WHEN n IN ('deno', 'ts-node', 'tsx') THEN 'typescript' ELSE '' END AS lang
    FROM (SELECT event_id, regexp_replace(string_split(CASE WHEN string_split(w[1], '/')[-1] = 'env' THEN coalesce(list_filter(w[2:], lambda f: NOT starts_with(f, '-') AND NOT contains(f, '='))[1], '') ELSE coalesce(w[1], '') END, '/')[-1], '[0-9.]+$', '') AS n
          FROM (SELECT event_id, list_filter(string_split_regex(regexp_extract(head, '^#!([^\\n]*)', 1), '\\s+'), lambda f: f <> '') AS w FROM heads))""",
    "heads AS (SELECT event_id, ([" + ", ".join("'" + h.replace("\n", "' || chr(10) || '") + "'" for h in _HEADS) + "])[event_id % 10 + 1] AS head FROM events)",
)
def x3_shebang_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.get(F.array(*[F.lit(h) for h in _HEADS]), (F.col("event_id") % len(_HEADS)).cast("int"))
    return A.table(spark, sf_dir, "events").select("event_id", C.shebang_lang(head).alias("lang"))


@query(f"SELECT event_id, {_category('path')} AS category FROM paths", A.PATHS)
def dc7_classify_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.paths(spark, sf_dir).select("event_id", C.category(F.col("path")).alias("category"))


_HIDDEN = "CASE lang WHEN 'go' THEN regexp_matches(name, '^[a-z]') WHEN 'python' THEN starts_with(name, '_') AND NOT starts_with(name, '__') WHEN 'typescript' THEN starts_with(name, '_') ELSE false END"


@query(f"SELECT rel_file, line, {_HIDDEN} AS unexported FROM tags", A.TAGS)
def dc3_unexported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tags(spark, sf_dir).select("rel_file", "line", C.unexported(F.col("name"), F.col("lang")).alias("unexported"))


@query("SELECT doc_id, regexp_replace(replace(lower(text), ' ', '-'), '[^a-z0-9-]', '', 'g') AS slug FROM documents")
def g1_slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents").select("doc_id", C.slug(F.col("text")).alias("slug"))


@query("SELECT rel_file, line, CASE WHEN lang = 'md' AND kind <> 'ref' THEN rel_file || '#' || regexp_replace(replace(lower(name), ' ', '-'), '[^a-z0-9-]', '', 'g') ELSE name END AS key FROM tags", A.TAGS)
def g2_symbol_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.tags(spark, sf_dir).withColumn("lang", F.when(F.col("lang") == "md", "markdown").otherwise(F.col("lang")))
    return t.select("rel_file", "line", C.symbol_key(*[F.col(c) for c in ("rel_file", "name", "kind", "lang")]).alias("key"))


_CAPTURES = ["name.reference.call", "name.definition.function", "name.definition.method", "name.definition.class", "name.definition.interface", "name.definition.type", "name.definition.variable", "name.definition.constant", "name.definition.module", "name.reference", "doc"]


@query("SELECT event_id, CASE WHEN starts_with(c, 'name.reference') THEN 'ref' WHEN c IN ('name.definition.module', 'doc') THEN 'def' ELSE string_split(c, '.')[3] END AS kind FROM (SELECT event_id, ([" + ", ".join(f"'{c}'" for c in _CAPTURES) + "])[event_id % 11 + 1] AS c FROM events)")
def x18_kind_of_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    capture = F.get(F.array(*[F.lit(c) for c in _CAPTURES]), (F.col("event_id") % len(_CAPTURES)).cast("int"))
    return A.table(spark, sf_dir, "events").select("event_id", C.kind_of(capture).alias("kind"))


_EXTERNAL = "(starts_with({0}, '//') OR regexp_matches(lower({0}), '^(https?://|ftp://|mailto:|tel:)') OR regexp_matches({0}, '^[A-Za-z0-9+.-]{{2,}}:'))"


@query(f"SELECT page_id, {_EXTERNAL.format('dest')} AS external, lower(regexp_extract(dest, '(\\.[^./]*)$', 1)) IN ('.png', '.jpg', '.jpeg', '.gif', '.webp', '.svg', '.pdf') AS image, trim(string_split(string_split(dest, '#')[1], '?')[1]) AS bare FROM links", A.LINKS)
def r2_r4_link_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("dest")
    return A.links(spark, sf_dir).select("page_id", C.is_external(d).alias("external"), C.is_image(d).alias("image"), C.strip_fragment(d).alias("bare"))


_FOLD = "list_reduce(list_prepend('', string_split({0}, '/')), lambda a, s: CASE WHEN a = '!' OR s IN ('', '.') THEN a WHEN s = '..' AND a = '' THEN '!' WHEN s = '..' THEN regexp_replace(a, '/?[^/]*$', '') WHEN a = '' THEN s ELSE a || '/' || s END)"


@query(f"SELECT page_id, CASE WHEN x IN ('!', '') THEN NULL ELSE x END AS target FROM (SELECT page_id, {_FOLD.format(chr(40) + 'regexp_extract(source, ' + chr(39) + '^(.*)/[^/]*$' + chr(39) + ', 1) || ' + chr(39) + '/' + chr(39) + ' || dest' + chr(41))} AS x FROM links)", A.LINKS)
def r5_resolve_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.links(spark, sf_dir).select("page_id", C.resolve_relative(F.col("dest"), F.col("source")).alias("target"))


_RESOLVED = f"""resolved AS (SELECT page_id, source, CASE WHEN dead THEN NULL WHEN wiki THEN (SELECT min(source) FROM links f WHERE regexp_replace(string_split(lower(f.source), '/')[-1], '\\.(md|markdown)$', '') = lower(t)) WHEN x IN ('!', '') THEN NULL ELSE x END AS target
    FROM (SELECT page_id, source, t, wiki, t = '' OR {_EXTERNAL.format('t')} OR regexp_matches(lower(t), '\\.(png|jpg|jpeg|gif|webp|svg|pdf)$') AS dead, {_FOLD.format("(regexp_extract(source, '^(.*)/[^/]*$', 1) || '/' || t)")} AS x
          FROM (SELECT page_id, source, string_split(string_split(string_split(d, '|')[1], '#')[1], '?')[1] AS t,
                       NOT (contains(d, '/') OR starts_with(d, '.') OR regexp_extract(string_split(string_split(d, '#')[1], '?')[1], '(\\.[^./]*)$', 1) <> '') AND NOT {_EXTERNAL.format('d')} AS wiki
                FROM (SELECT page_id, source, regexp_replace(dest, '^\\[\\[|\\]\\]$', '', 'g') AS d FROM links))))"""


@query("SELECT page_id, target FROM resolved", A.LINKS, _RESOLVED)
def r1_r6_resolve_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = A.links(spark, sf_dir)
    out = graph.resolve_links(links.select("page_id", F.col("source").alias("rel_file"), F.col("dest").alias("name")), links.select(F.col("source").alias("rel_file")).distinct())
    return out.select("page_id", "target")


_TOKENS = "(length(regexp_replace({0}, '[^0-9]', '', 'g')) + ((strlen({0}) - length(regexp_replace({0}, '[^0-9]', '', 'g'))) * 10 + 31) // 32)::INTEGER"


@query(f"SELECT doc_id, {_TOKENS.format('text')} AS tokens, (strlen(text) // 4)::INTEGER AS quarter FROM documents")
def tb1_tb2_token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return A.table(spark, sf_dir, "documents").select("doc_id", C.estimate_tokens(t).alias("tokens"), C.quarter_tokens(t).alias("quarter"))


@query("SELECT event_id, CASE WHEN v <= 0 THEN 1500 ELSE least(v, 8000) END::INTEGER AS budget FROM (SELECT event_id, (event_id % 9 - 1) * 1700 AS v FROM events)")
def tb3_budget_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = ((F.col("event_id") % 9 - 1) * 1700).cast("int")
    return A.table(spark, sf_dir, "events").select("event_id", C.budget(asked, 1500).alias("budget"))


@query("SELECT event_id, len(list_intersect(string_split(path, '/'), ['.git', 'node_modules', '.tagloom', 'vendor', 'dist', 'build', 'out', '.angular', '.next', '.nuxt', '.svelte-kit', '__pycache__', '.pytest_cache', '.mypy_cache', 'coverage', '.nyc_output', '.turbo', '.cache', '.obsidian', '.trash'])) > 0 OR regexp_matches(string_split(path, '/')[-1], '(\\.d\\.ts|\\.min\\.js|\\.pb\\.go|\\.gen\\.go|\\.canvas|\\.excalidraw|\\.db|\\.db-wal|\\.db-shm)$') AS ignored FROM paths", A.PATHS)
def i1_i2_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.paths(spark, sf_dir).select("event_id", C.ignored_by_default(F.col("path")).alias("ignored"))


# ---------------------------------------------------------------- graph


@query("SELECT src, dst, weight FROM edges", A.TAGS, A.EDGES)
def g5_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(A.tags(spark, sf_dir), markdown=False)


@query("SELECT r.key, r.rel_file FROM refs r JOIN defs d ON r.key = d.key AND r.rel_file = d.rel_file", A.WIDE, A.EDGES)
def g6_shadowed_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shadowed(A.tags(spark, sf_dir, wide=True))


@query(
    """SELECT r.source AS src, d.source AS dst, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT DISTINCT source, target FROM resolved WHERE target <> source) r
    JOIN (SELECT DISTINCT source FROM links) d ON d.source = r.target GROUP BY 1, 2""",
    A.LINKS, _RESOLVED,
)
def g4_markdown_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(A.notes(spark, sf_dir))


@query(
    r"""SELECT DISTINCT source AS rel_file, source || '#part-' || (page_id % 3) AS key, 'def' AS side FROM links UNION SELECT source, source, 'def' FROM links
    UNION SELECT source, target, 'ref' FROM resolved WHERE target IS NOT NULL""",
    A.LINKS, _RESOLVED,
)
def g4_markdown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.notes(spark, sf_dir)
    return graph.definitions(t).withColumn("side", F.lit("def")).union(graph.references(t).withColumn("side", F.lit("ref")))


@query("SELECT key, rel_file, 'def' AS side FROM defs UNION ALL SELECT key, rel_file, 'ref' FROM refs", A.TAGS, A.EDGES)
def g3_definitions_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.tags(spark, sf_dir)
    return graph.definitions(t).withColumn("side", F.lit("def")).union(graph.references(t, False).withColumn("side", F.lit("ref")))


@query("SELECT DISTINCT rel_file FROM tags", A.TAGS)
def g7_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tags(spark, sf_dir).select("rel_file").distinct()


@query("SELECT src, sum(weight) AS out_weight FROM edges GROUP BY 1", A.TAGS, A.EDGES)
def g9_out_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.out_weight(graph.links(A.tags(spark, sf_dir), markdown=False))


def _rank_sql(rounds: int = 15, d: float = 0.85) -> str:
    out = [
        "nodes AS MATERIALIZED (SELECT DISTINCT rel_file FROM tags)", "me AS MATERIALIZED (SELECT * FROM edges)",
        "ow AS MATERIALIZED (SELECT src, sum(weight) AS o FROM me GROUP BY 1)", "cn AS (SELECT count(*)::DOUBLE AS n FROM nodes)",
        "r0 AS MATERIALIZED (SELECT rel_file, 1.0 / (SELECT n FROM cn) AS rank FROM nodes)",
    ]
    for i in range(1, rounds + 1):
        out.append(f"l{i} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) AS x FROM r{i - 1} WHERE rel_file NOT IN (SELECT src FROM ow))")
        out.append(f"s{i} AS MATERIALIZED (SELECT e.dst, sum(r.rank * e.weight / ow.o) AS x FROM me e JOIN r{i - 1} r ON e.src = r.rel_file JOIN ow ON ow.src = e.src GROUP BY 1)")
        out.append(f"r{i} AS MATERIALIZED (SELECT n.rel_file, {1 - d} / (SELECT n FROM cn) + {d} * (SELECT x FROM l{i}) / (SELECT n FROM cn) + {d} * coalesce(s.x, 0) AS rank FROM nodes n LEFT JOIN s{i} s ON n.rel_file = s.dst)")
    out.append(f"ranks AS MATERIALIZED (SELECT rel_file, rank / (SELECT sum(rank) FROM r{rounds}) AS rank FROM r{rounds})")
    return ",\n".join(out)


RANKS = _rank_sql()


@query("SELECT rel_file, round(rank, 9) AS rank FROM ranks", A.TAGS, A.EDGES, RANKS)
def g8_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, mine = A.tags(spark, sf_dir), []
    ranks = graph.pagerank(t.select("rel_file"), graph.links(t, False, True, mine))
    discard(spark, mine)
    return ranks.select("rel_file", F.round("rank", 9).alias("rank"))


_tables: dict = {}


def _shared(spark: SparkSession, sf_dir: str, name: str):
    """The links or ranks of a tag relation, computed once a session: all queries that need them read the same tables."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        t = A.tags(spark, sf_dir)
        _tables[key] = graph.links(t, markdown=False, tables=True) if name == "links" else graph.pagerank(t.select("rel_file"), _shared(spark, sf_dir, "links"))
    return _tables[key]


# ---------------------------------------------------------------- dead code and blast radius


_DEAD = f"dead AS (SELECT rel_file, name, line, kind, lang, {_category('rel_file')} AS category FROM tags WHERE kind <> 'ref' AND name NOT IN (SELECT name FROM tags WHERE kind = 'ref'))"


@query("SELECT rel_file, name, line, kind, category FROM dead WHERE category <> 'test'", A.TAGS, _DEAD)
def dc1_dead_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadcode.dead_symbols(A.tags(spark, sf_dir))


@query(f"SELECT rel_file, name, line, kind, category FROM dead WHERE kind = 'function' AND {_HIDDEN}", A.TAGS, _DEAD)
def dc2_dead_unexported_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadcode.dead_symbols(A.tags(spark, sf_dir), include_tests=True, kinds=["function", ""], unexported_only=True)


@query("SELECT count(*) FILTER (category = 'test') AS hidden_tests FROM dead", A.TAGS, _DEAD)
def dc4_hidden_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadcode.hidden_tests(A.tags(spark, sf_dir))


_ORPHANS = f"orphan AS (SELECT rel_file, rank, {_category('rel_file')} AS category FROM ranks WHERE rel_file NOT IN (SELECT dst FROM edges))"


@query("SELECT rel_file, round(rank, 9) AS rank, category FROM orphan WHERE rank <= 0.001 AND category = 'source'", A.TAGS, A.EDGES, RANKS, _ORPHANS)
def dc5_orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.tags(spark, sf_dir)
    e = _shared(spark, sf_dir, "links")
    return deadcode.orphans(t.select("rel_file").distinct(), e, _shared(spark, sf_dir, "ranks")).select("rel_file", F.round("rank", 9).alias("rank"), "category")


@query(
    """SELECT d.n || ' dead symbols, ' || o.n || ' orphan files' || CASE WHEN d.h + o.h = 0 THEN '' ELSE ' (' || array_to_string(list_filter([CASE WHEN d.h > 0 THEN d.h || ' test symbols hidden; set include_test_symbols to show' END, CASE WHEN o.h > 0 THEN o.h || ' test/docs orphans hidden; set include_test_orphans / include_doc_orphans to show' END], lambda x: x IS NOT NULL), '; ') || ')' END AS summary
    FROM (SELECT count(*) FILTER (category <> 'test') AS n, count(*) FILTER (category = 'test') AS h FROM dead) d, (SELECT count(*) FILTER (category = 'source') AS n, count(*) FILTER (category <> 'source') AS h FROM orphan WHERE rank <= 1) o""",
    A.TAGS, A.EDGES, RANKS, _DEAD, _ORPHANS,
)
def dc6_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.tags(spark, sf_dir)
    e = _shared(spark, sf_dir, "links")
    o = deadcode.orphan_candidates(t.select("rel_file").distinct(), e, _shared(spark, sf_dir, "ranks"), 1.0)
    return deadcode.summary(deadcode.dead_candidates(t), o)


_SYMBOL = "k17_26"  # a name that the tag relation both defines and references
_BFS = f"""seed AS (SELECT DISTINCT rel_file FROM tags WHERE kind <> 'ref' AND name = '{_SYMBOL}'),
h1 AS (SELECT DISTINCT src AS f FROM edges WHERE dst IN (SELECT rel_file FROM seed) AND src NOT IN (SELECT rel_file FROM seed)),
h2 AS (SELECT DISTINCT src AS f FROM edges WHERE dst IN (SELECT f FROM h1) AND src NOT IN (SELECT rel_file FROM seed UNION SELECT f FROM h1)),
h3 AS (SELECT DISTINCT src AS f FROM edges WHERE dst IN (SELECT f FROM h2) AND src NOT IN (SELECT rel_file FROM seed UNION SELECT f FROM h1 UNION SELECT f FROM h2)),
reached AS (SELECT f, 1 AS depth FROM h1 UNION ALL SELECT f, 2 FROM h2 UNION ALL SELECT f, 3 FROM h3)"""


@query(f"SELECT rel_file, line FROM tags WHERE kind <> 'ref' AND name = '{_SYMBOL}'", A.TAGS)
def b1_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blast.seeds(A.tags(spark, sf_dir), _SYMBOL)


@query("SELECT rel_file, 0 AS depth FROM seed UNION ALL SELECT f, depth FROM reached", A.TAGS, A.EDGES, _BFS)
def b2_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.tags(spark, sf_dir)
    return graph.reach(_shared(spark, sf_dir, "links"), blast.seeds(t, _SYMBOL), 3)


@query(f"SELECT r.f AS file, coalesce(t.name, '') AS symbol, coalesce(t.line, 0)::INTEGER AS line, r.depth FROM reached r LEFT JOIN tags t ON t.rel_file = r.f AND t.kind = 'ref' AND t.name = '{_SYMBOL}'", A.TAGS, A.EDGES, _BFS)
def b3_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.tags(spark, sf_dir)
    return blast.dependents(t, _shared(spark, sf_dir, "links"), _SYMBOL)


@query(f"SELECT '{_SYMBOL}' AS symbol, coalesce((SELECT rel_file || ':' || line FROM tags WHERE kind <> 'ref' AND name = '{_SYMBOL}' ORDER BY rel_file, line LIMIT 1), '') AS defined_in, count(DISTINCT f)::INTEGER AS total_files_affected FROM reached", A.TAGS, A.EDGES, _BFS)
def b4_blast_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.tags(spark, sf_dir)
    return blast.blast_radius(t, _shared(spark, sf_dir, "links"), _SYMBOL).select("symbol", "defined_in", "total_files_affected")


# ---------------------------------------------------------------- changes


@query("SELECT user_id, 'f' || event_id || '.py' AS file, (event_id % 50 + 1)::INTEGER AS \"start\", (event_id % 50 + 1 + CASE WHEN event_id % 3 = 2 THEN 3 ELSE 0 END)::INTEGER AS \"end\" FROM events WHERE event_id % 7 <> 0")
def t1_parse_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = A.table(spark, sf_dir, "events"), F.col("event_id")
    name = F.when(i % 7 == 0, "/dev/null").otherwise(F.concat(F.lit("f"), i.cast("string"), F.lit(".py"), F.when(i % 2 == 0, "\tstamp").otherwise("")))
    count = F.when(i % 3 == 0, "").when(i % 3 == 1, ",0").otherwise(",4")
    one = F.concat(F.lit("diff --git a/x b/x\n+++ b/"), name, F.lit("\n@@ -1 +"), (i % 50 + 1).cast("string"), count, F.lit(" @@"))
    diffs = e.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", one.alias("t")))), lambda x: x["t"]), "\n").alias("diff"))
    return changes.parse_diff(diffs, ["user_id"])


_HIT = """hit AS (SELECT t.rel_file, t.name, t.kind, t.line, greatest(t.end_line, t.line) AS e2, h."start" AS hs, h."end" AS he FROM tags t JOIN hunks h ON h.file = t.rel_file AND h."start" <= greatest(t.end_line, t.line) AND h."end" >= t.line WHERE t.kind <> 'ref'),
changed AS (SELECT DISTINCT rel_file AS file, name AS symbol, line, kind, CASE WHEN own THEN 'definition' ELSE 'body' END AS reason FROM (
  SELECT a.*, max(line BETWEEN hs AND he) OVER (PARTITION BY rel_file, line) AS own,
     NOT EXISTS (SELECT 1 FROM hit o WHERE o.rel_file = a.rel_file AND o.hs = a.hs AND o.he = a.he AND o.line >= a.line AND o.e2 <= a.e2 AND (o.line > a.line OR o.e2 < a.e2)) AS free
  FROM hit a) WHERE own OR free)"""


@query('SELECT DISTINCT rel_file, name, line, hs AS "start", he AS "end" FROM hit', A.TAGS, A.HUNKS, _HIT)
def t2_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.touched(A.tags(spark, sf_dir, spans=True), A.hunks(spark, sf_dir)).select("rel_file", "name", "line", "start", "end")


@query("SELECT * FROM changed", A.TAGS, A.HUNKS, _HIT)
def t3_t4_changed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.changed_symbols(A.tags(spark, sf_dir, spans=True), A.hunks(spark, sf_dir))


@query(
    """SELECT s.symbol, s.file, count(DISTINCT r.f)::INTEGER AS total_files_affected FROM ks s LEFT JOIN (
       SELECT symbol, file, src AS f FROM w1 UNION SELECT symbol, file, src FROM w2 UNION SELECT symbol, file, src FROM w3) r ON r.symbol = s.symbol AND r.file = s.file AND r.f <> s.file GROUP BY 1, 2""",
    A.TAGS, A.EDGES, A.HUNKS, _HIT,
    """ks AS (SELECT DISTINCT symbol, file FROM changed), w1 AS (SELECT DISTINCT symbol, file, src FROM ks JOIN edges ON dst = file), w2 AS (SELECT DISTINCT symbol, file, e.src FROM w1 JOIN edges e ON e.dst = w1.src), w3 AS (SELECT DISTINCT symbol, file, e.src FROM w2 JOIN edges e ON e.dst = w2.src)""",
)
def t5_changed_blast(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.tags(spark, sf_dir, spans=True)
    return changes.changed_blast(t, _shared(spark, sf_dir, "links"), changes.changed_symbols(t, A.hunks(spark, sf_dir)))


@query("""SELECT count(*) || ' changed symbols across ' || (SELECT count(DISTINCT file) FROM hunks) || ' files' || CASE WHEN count(*) FILTER (reason = 'body') > 0 THEN ' (' || count(*) FILTER (reason = 'body') || ' attributed to enclosing definitions)' ELSE '' END AS summary FROM changed""", A.TAGS, A.HUNKS, _HIT)
def t6_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = A.hunks(spark, sf_dir)
    return changes.summary(changes.changed_symbols(A.tags(spark, sf_dir, spans=True), h), h)


# ---------------------------------------------------------------- search and map


@query("SELECT rel_file, line, name, kind FROM tags WHERE contains(lower(name), 'k1_3') AND kind <> 'ref' ORDER BY rel_file, line LIMIT 50", A.TAGS)
def si1_search_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_identifiers(A.tags(spark, sf_dir), "K1_3", "defs").select("rel_file", "line", "name", "kind")


_SEARCH = f"""hits AS (SELECT CASE WHEN lower(name) = 'k1_3' THEN 0 WHEN starts_with(lower(name), 'k1_3') THEN 1 ELSE 2 END AS class, rel_file, line, end_line, kind, name, rank FROM tags JOIN ranks USING (rel_file) WHERE contains(lower(name), 'k1_3') AND NOT {_test_of('rel_file')})"""


@query("SELECT class, rel_file, line, kind, name, row_number() OVER (ORDER BY class, kind = 'ref', round(rank, 12) DESC, rel_file, line)::INTEGER AS place FROM hits", A.TAGS, A.EDGES, RANKS, _SEARCH)
def se1_se2_search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.tags(spark, sf_dir, spans=True)
    return search.search(t, _shared(spark, sf_dir, "ranks").select("rel_file", F.round("rank", 12).alias("rank")), " K1_3 ", refs=True).select("class", "rel_file", "line", "kind", "name", "place")


@query(
    f"""SELECT place, entry FROM (SELECT place, entry, sum({_TOKENS.format('entry')}) OVER (ORDER BY place) AS used FROM (
        SELECT row_number() OVER (ORDER BY class, kind = 'ref', round(rank, 12) DESC, rel_file, line)::INTEGER AS place,
               CASE WHEN kind = 'ref' THEN rel_file || ':' || line || ' ref ' || name ELSE rel_file || ':' || line || CASE WHEN end_line > line THEN '-' || end_line ELSE '' END || ' ' || kind || ' ' || name END || chr(10) AS entry FROM hits)) WHERE used + 20 + 40 <= 600""",
    A.TAGS, A.EDGES, RANKS, _SEARCH,
)
def se3_search_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.tags(spark, sf_dir, spans=True)
    hits = search.search(t, _shared(spark, sf_dir, "ranks").select("rel_file", F.round("rank", 12).alias("rank")), "k1_3", refs=True, most=600)
    return search.within_budget(search.search_entries(hits), "place", 20, 600, 40).select("place", "entry")


@query(
    """SELECT place, rel_file, section FROM (SELECT rel_file, section, row_number() OVER o::INTEGER AS place, sum(strlen(section)) OVER o AS b FROM (
        SELECT rel_file, round(any_value(rank), 12) AS rank, rel_file || ':' || chr(10) || '(Rank: ' || printf('%.2f', round(any_value(rank), 12) * 100) || ')' || chr(10) || string_agg('  ' || line || ': ' || name || chr(10), '' ORDER BY line) || '⋮...' || chr(10) AS section
        FROM tags JOIN ranks USING (rel_file) WHERE kind <> 'ref' GROUP BY rel_file) WINDOW o AS (ORDER BY rank DESC, rel_file)) WHERE b // 4 <= 2048 OR place = 1""",
    A.TAGS, A.EDGES, RANKS,
)
def m1_repo_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.tags(spark, sf_dir)
    return search.repo_map(search.map_sections(t, _shared(spark, sf_dir, "ranks").select("rel_file", F.round("rank", 12).alias("rank"))), 2048)


# ---------------------------------------------------------------- callers


_SCOPE = """sc AS (SELECT * FROM tags WHERE kind IN ('function', 'method', 'class')),
enc AS (SELECT r.rel_file, r.line, f.name AS fn_name, f.line AS fn_line, f.end_line AS fn_end, f.kind AS fn_kind, row_number() OVER (PARTITION BY r.rel_file, r.line ORDER BY f.line DESC, f.end_line, f.ord) AS k
  FROM (SELECT DISTINCT rel_file, line FROM tags WHERE kind = 'ref') r JOIN sc f ON f.rel_file = r.rel_file AND f.line <= r.line AND f.end_line >= r.line),
scope AS (SELECT e.rel_file, e.line, e.fn_name, e.fn_line, e.fn_end, CASE WHEN e.fn_kind <> 'class' AND c.name IS NOT NULL THEN c.name || '.' || e.fn_name ELSE e.fn_name END AS scope FROM enc e
  LEFT JOIN LATERAL (SELECT name FROM sc c WHERE c.kind = 'class' AND c.rel_file = e.rel_file AND c.line <= e.fn_line AND c.end_line >= e.fn_end AND (c.line < e.fn_line OR c.end_line > e.fn_end) ORDER BY c.line DESC, c.ord LIMIT 1) c ON true WHERE e.k = 1)"""


@query("SELECT r.rel_file, r.line, s.scope, s.fn_name, s.fn_line, s.fn_end FROM (SELECT DISTINCT rel_file, line FROM tags WHERE kind = 'ref') r LEFT JOIN scope s USING (rel_file, line)", A.TAGS, _SCOPE)
def w1_enclosing_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.tags(spark, sf_dir, spans=True)
    sites = t.where("kind = 'ref'").select("rel_file", "line").distinct()
    return callers.enclosing(sites, t).select("rel_file", "line", "scope", "fn_name", "fn_line", "fn_end")


@query(
    f"""SELECT name, rel_file, line, CASE WHEN origin <> '' AND rel_file <> origin AND rel_file IN (SELECT rel_file FROM df) AND (SELECT count(*) FROM df) >= 2 THEN 'elsewhere' WHEN {_test_of('rel_file')} THEN 'test' ELSE 'shown' END AS status
    FROM (SELECT DISTINCT name, rel_file, line, (SELECT min(rel_file) FROM df) AS origin FROM tags WHERE kind = 'ref' AND name = '{_SYMBOL}')""",
    A.TAGS, f"df AS (SELECT DISTINCT rel_file FROM tags WHERE kind <> 'ref' AND name = '{_SYMBOL}')",
)
def ca1_ca2_ref_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.tags(spark, sf_dir)
    wanted = callers.def_files(t).where(F.col("name") == _SYMBOL).groupBy("name").agg(F.min("def_file").alias("origin"))
    return callers.ref_sites(t, None, wanted).select("name", "rel_file", "line", "status")


@query("SELECT DISTINCT name, rel_file AS def_file FROM tags WHERE kind <> 'ref'", A.TAGS)
def ca3_def_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callers.def_files(A.tags(spark, sf_dir))


@query("SELECT rel_file, line FROM lines WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])') AND line % 3 <> 0", A.LINES)
def ca4_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = A.lines(spark, sf_dir)
    tags = ls.select("rel_file", "line", F.lit(0).alias("end_line"), F.when(F.col("line") % 3 == 0, "the").otherwise("other").alias("name"), F.lit("ref").alias("kind"), F.lit("python").alias("lang"), F.col("line").alias("ord"))
    return callers.mentions(tags, ls, "the").where("NOT hidden").select("rel_file", "line")


# 160 bytes; a character that the cut breaks is one U+FFFD
_BYTES = "encode(t)[1:{}]"
_CLIPPED = "CASE WHEN strlen(t) > 160 THEN coalesce(try(decode(" + _BYTES.format(160) + ")), " + ", ".join(f"try(decode({_BYTES.format(160 - i)})) || chr(65533)" for i in (1, 2, 3)) + ") || '…' ELSE t END"
_BLANK = r"[\s\x{0B}\x{85}\p{Z}]+"


@query(f"SELECT rel_file, line, {_CLIPPED} AS text FROM (SELECT rel_file, line, replace(regexp_replace(regexp_replace(text, '^{_BLANK}', ''), '{_BLANK}$', ''), chr(9), ' ') AS t FROM lines WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])token($|[^A-Za-z0-9_])'))", A.LINES)
def ca5_ca6_text_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = A.lines(spark, sf_dir)
    files = A.table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_file"), F.octet_length("text").alias("size"))
    none = A.tags(spark, sf_dir).where("false")
    return callers.text_sites(none, files, ls, "token").select("rel_file", "line", "text")


_CALLED = "k5"
_DEEP = f"""own AS (SELECT DISTINCT rel_file FROM tags WHERE kind <> 'ref' AND name = '{_CALLED}'),
lv1 AS (SELECT DISTINCT t.rel_file, t.line, s.fn_name, s.scope FROM tags t LEFT JOIN scope s USING (rel_file, line) WHERE t.kind = 'ref' AND t.name = '{_CALLED}' AND NOT {_test_of('t.rel_file')}
  AND NOT (t.rel_file IN (SELECT rel_file FROM own) AND (SELECT count(*) FROM own) >= 2)),
nx AS (SELECT fn_name AS name, count(*) AS n FROM lv1 WHERE fn_name IS NOT NULL AND fn_name <> '{_CALLED}' GROUP BY 1)"""


@query(f"SELECT 1 AS depth, '{_CALLED}' AS name, count(*) AS sites FROM lv1 HAVING count(*) > 0 UNION ALL SELECT 2, nx.name, count(DISTINCT (t.rel_file, t.line)) FROM nx JOIN tags t ON t.name = nx.name AND t.kind = 'ref' GROUP BY 2", A.WIDE, _SCOPE, _DEEP)
def ca9_callers_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites by level and name; on the second level those of all statuses."""
    out = callers.callers(A.tags(spark, sf_dir, spans=True, wide=True), None, _CALLED, file="-", depth=2)
    return out.where("depth = 2 OR status = 'shown'").groupBy("depth", "name").agg(F.count(F.lit(1)).alias("sites"))


@query("SELECT rel_file, line, CASE WHEN fn_name IN ('__init__', 'constructor', '__new__') THEN CASE WHEN contains(scope, '.') THEN string_split(scope, '.')[1] END ELSE fn_name END AS caller FROM scope", A.TAGS, _SCOPE)
def ca10_caller_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.tags(spark, sf_dir, spans=True)
    sites = callers.enclosing(t.where("kind = 'ref'").select("rel_file", "line").distinct(), t).where("fn_name IS NOT NULL")
    return sites.select("rel_file", "line", callers.caller_name(F.col("fn_name"), F.col("scope")).alias("caller"))


@query("SELECT rel_file, site, l.line, CASE WHEN l.line = site THEN '>' ELSE ' ' END AS mark FROM (SELECT rel_file, line AS site FROM lines) s JOIN lines l USING (rel_file) WHERE l.line BETWEEN site - 1 AND site + 1", A.LINES)
def ca11_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = A.lines(spark, sf_dir)
    return callers.with_context(ls, ls, 1).select("rel_file", "site", "line", "mark")


@query("SELECT rel_file, line, CASE WHEN end_line > line THEN line || '-' || end_line ELSE line::VARCHAR END AS span FROM tags", A.TAGS)
def ca12_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tags(spark, sf_dir, spans=True).select("rel_file", "line", C.span(F.col("line"), F.col("end_line")).alias("span"))


@query("SELECT event_id, path = 'p1' OR starts_with(path, 'p1/') AS inside FROM paths", A.PATHS)
def ca7_under_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.paths(spark, sf_dir).select("event_id", C.under(F.col("path"), " ./p0/../p1/ ").alias("inside"))


# ---------------------------------------------------------------- outline


_KEPT = "od AS (SELECT * FROM tags WHERE kind IN ('function', 'method', 'class', 'interface', 'type', 'def')), oo AS (SELECT * FROM od WHERE kind IN ('function', 'method', 'class') AND end_line > line)"


@query("SELECT d.rel_file, d.line, d.end_line, d.kind, d.name, (SELECT count(*) FROM oo o WHERE o.rel_file = d.rel_file AND o.line < d.line AND o.end_line >= d.line)::INTEGER AS depth FROM od d", A.TAGS, _KEPT)
def ou2_file_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.file_outline(A.tags(spark, sf_dir, spans=True))


@query("SELECT rel_file, line, kind, name, row_number() OVER (PARTITION BY rel_file ORDER BY line)::INTEGER AS place FROM od d WHERE NOT EXISTS (SELECT 1 FROM oo o WHERE o.rel_file = d.rel_file AND ((o.line < d.line AND o.end_line >= d.end_line) OR (o.line = d.line AND o.end_line > d.end_line)))", A.TAGS, _KEPT)
def ou4_top_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.top_level(A.tags(spark, sf_dir, spans=True)).select("rel_file", "line", "kind", "name", "place")


@query("SELECT source || '/' || doc_id || '.txt' AS rel_file, (len(string_split(text, chr(10))) - CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END)::INTEGER AS n_lines FROM documents")
def ca12_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents")
    return outline.line_counts(d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_file"), "text"))


@query(None)
def ou3_directory_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.tags(spark, sf_dir, spans=True)
    counts = t.groupBy("rel_file").agg(F.max("line").alias("n_lines"))
    return outline.chosen(outline.directory_entries(t, counts), _shared(spark, sf_dir, "ranks").select("rel_file", F.round("rank", 12).alias("rank")), 40, 1500)


# ---------------------------------------------------------------- cache, status, sessions


@query("SELECT rel_file, line, name, kind, ord FROM tags", A.TAGS)
def x17_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.tags(spark, sf_dir, dealt=True)
    twice = t.withColumn("ord", F.explode(F.array("ord", F.col("ord") + 1_000_000)))
    return cache.deduplicated(twice).select("rel_file", "line", "name", "kind", "ord")


_CACHE = "fs AS (SELECT DISTINCT user_id AS u FROM events)"


@query("SELECT 'u' || u AS rel_file, u * 10 AS mtime_ns, u % 3 <> 0 AND u % 4 <> 0 AS hit FROM fs", _CACHE)
def s5_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, cached, _ = _cache_tables(spark, sf_dir)
    return cache.split_hits(files, cached)


@query("SELECT 'u' || u AS rel_file, CASE WHEN u % 5 = 0 THEN u * 10 + 7 WHEN u % 4 = 0 THEN u * 10 + 1 ELSE u * 10 END AS mtime_ns FROM fs WHERE u % 3 <> 0 OR u % 5 = 0", _CACHE)
def k1_cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cached, fresh = _cache_tables(spark, sf_dir)
    return cache.upsert(cached, fresh)


@query("SELECT 'u' || u AS rel_file, CASE WHEN u % 4 = 0 THEN u * 10 + 1 ELSE u * 10 END AS mtime_ns FROM fs WHERE u % 3 <> 0 AND u % 5 <> 0", _CACHE)
def k2_cache_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cached, fresh = _cache_tables(spark, sf_dir)
    return cache.invalidate(cached, fresh)


def _cache_tables(spark: SparkSession, sf_dir: str):
    u = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("u")).distinct()
    rel, at = F.concat(F.lit("u"), F.col("u").cast("string")).alias("rel_file"), F.col("u") * 10
    return (
        u.select(rel, at.alias("mtime_ns")),
        u.where("u % 3 <> 0").select(rel, (at + (F.col("u") % 4 == 0).cast("int")).alias("mtime_ns")),
        u.where("u % 5 = 0").select(rel, (at + 7).alias("mtime_ns")),
    )


@query("SELECT string_split(rel_file, '/')[1] AS project, count(DISTINCT rel_file) AS files, count(*) AS tags, count(*) * 80 AS memory_bytes FROM tags GROUP BY 1", A.TAGS)
def a14_project_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.status(A.tags(spark, sf_dir), F.substring_index("rel_file", "/", 1))


@query(
    """SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS changes FROM (
         SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
           SELECT event_id, user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"""
)
def st2_debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = sessions.debounced(e, "ts", ["user_id"], "30 minutes")
    return out.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "changes")


@query("SELECT event_id, strftime(ts, '%H:%M:%S') || ' ' || rpad(event_type, 20, ' ') || ' u' || user_id || ' value=' || CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) AS line FROM events")
def st9_event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    rows = e.select("event_id", "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("project"), F.col("event_type").alias("type"), F.create_map(F.lit("value"), F.floor("value").cast("int").cast("string")).alias("fields"))
    return rows.select("event_id", sessions.event_line(rows).alias("line"))
