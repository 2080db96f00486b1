"""Relations of the engine derived from the test tables, in Spark and, with the same rules, in SQL text.

The test tables hold no source code, so tags come from ``events``: a file for each user and day, definitions from signups and
purchases, references from all else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rel_file():
    day, user = F.datediff("ts", F.lit("2024-01-01").cast("date")), F.col("user_id")
    ext = F.when(user % 13 == 0, ".md").when(user % 3 == 0, ".go").when(user % 3 == 1, ".py").otherwise(".ts")
    return F.concat(F.lit("p"), (day % 5).cast("string"), F.lit("/"), F.when(user % 10 == 9, "tests/").otherwise(""), F.lit("u"), user.cast("string"), F.lit("_"), day.cast("string"), ext)


#: Rows of ``events`` that a partition of dealt tags has on average.
DEALT = 200_000


def tags(spark: SparkSession, sf_dir: str, spans: bool = False, wide: bool = False, dealt: bool = False) -> DataFrame:
    """rel_file, line, end_line, name, kind, lang, ord.  A class runs to the next class, a function to the next definition.

    ``wide`` files hold all days of a user and few names, so that files refer to names of their own and callers have callers.
    ``dealt`` tags lie by file in as many partitions as their number asks for, so what a task sorts does not grow with the input.
    """
    e = table(spark, sf_dir, "events")
    user, rel = F.col("user_id"), _rel_file()
    if wide:
        rel = F.regexp_replace(F.regexp_replace(rel, "^p[0-9-]+", "p"), r"_[0-9-]+\.", ".")
    name = F.concat(F.lit("k"), (F.col("event_id") % 37).cast("string")) if wide else F.concat(F.when(F.col("event_id") % 3 == 0, "_").otherwise(""), F.lit("k"), F.regexp_extract("props", r"(\d+)", 1).cast("int").cast("string"), F.lit("_"), (F.col("event_id") % 37).cast("string"))
    kind = F.when(F.col("event_type") == "signup", "function").when(F.col("event_type") == "purchase", "class").otherwise("ref")
    lang = F.when(user % 13 == 0, "md").when(user % 3 == 0, "go").when(user % 3 == 1, "python").otherwise("typescript")
    w = Window.partitionBy("rel_file").orderBy("ts", "event_id")
    out = e.select("event_id", "ts", rel.alias("rel_file"), name.alias("name"), kind.alias("kind"), lang.alias("lang"))
    if dealt:
        out = out.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-e.count() // DEALT)), "rel_file")
    out = out.withColumn("line", F.row_number().over(w))
    if not spans:
        return out.select("rel_file", "line", F.lit(0).alias("end_line"), "name", "kind", "lang", F.col("line").alias("ord"))
    # running minima from the last line up: a frame that ends at the last row is computed anew for each row
    after = Window.partitionBy("rel_file").orderBy(F.col("line").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("rel_file")
    next_class = F.min(F.when(F.col("kind") == "class", F.col("line"))).over(after)
    next_def = F.min(F.when(F.col("kind") != "ref", F.col("line"))).over(after)
    last = F.max("line").over(whole)
    end = F.when(F.col("kind") == "class", F.coalesce(next_class - 1, last)).when(F.col("kind") == "function", F.coalesce(next_def - 1, last)).otherwise(0)
    return out.select("rel_file", "line", end.alias("end_line"), "name", "kind", "lang", F.col("line").alias("ord"))


TAGS = r"""
e AS (SELECT *, date_diff('day', TIMESTAMP '2024-01-01', ts) AS d FROM events),
p AS (SELECT event_id, ts,
   'p' || (d % 5) || '/' || CASE WHEN user_id % 10 = 9 THEN 'tests/' ELSE '' END || 'u' || user_id || '_' || d ||
   CASE WHEN user_id % 13 = 0 THEN '.md' WHEN user_id % 3 = 0 THEN '.go' WHEN user_id % 3 = 1 THEN '.py' ELSE '.ts' END AS rel_file,
   CASE WHEN user_id % 13 = 0 THEN 'md' WHEN user_id % 3 = 0 THEN 'go' WHEN user_id % 3 = 1 THEN 'python' ELSE 'typescript' END AS lang,
   CASE event_type WHEN 'signup' THEN 'function' WHEN 'purchase' THEN 'class' ELSE 'ref' END AS kind,
   CASE WHEN event_id % 3 = 0 THEN '_' ELSE '' END || 'k' || CAST(regexp_extract(props, '(\d+)', 1) AS INT) || '_' || (event_id % 37) AS name
   FROM e),
t0 AS (SELECT rel_file, CAST(row_number() OVER (PARTITION BY rel_file ORDER BY ts, event_id) AS INTEGER) AS line, name, kind, lang FROM p),
tags AS (SELECT rel_file, line, name, kind, lang, line AS ord,
   CAST(CASE WHEN kind = 'class' THEN coalesce(min(CASE WHEN kind = 'class' THEN line END) OVER nxt - 1, max(line) OVER f)
             WHEN kind = 'function' THEN coalesce(min(CASE WHEN kind <> 'ref' THEN line END) OVER nxt - 1, max(line) OVER f) ELSE 0 END AS INTEGER) AS end_line
   FROM t0 WINDOW nxt AS (PARTITION BY rel_file ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), f AS (PARTITION BY rel_file))"""

WIDE = TAGS.replace("'p' || (d % 5)", "'p'").replace("|| user_id || '_' || d ||", "|| user_id ||").replace("CASE WHEN event_id % 3 = 0 THEN '_' ELSE '' END || 'k' || CAST(regexp_extract(props, '(\\d+)', 1) AS INT) || '_' || (event_id % 37)", "'k' || (event_id % 37)")

EDGES = """
defs AS (SELECT DISTINCT name AS key, rel_file FROM tags WHERE kind <> 'ref'),
refs AS (SELECT DISTINCT name AS key, rel_file FROM tags WHERE kind = 'ref'),
far AS (SELECT r.key, r.rel_file FROM refs r WHERE NOT EXISTS (SELECT 1 FROM defs d WHERE d.key = r.key AND d.rel_file = r.rel_file)),
edges AS (SELECT f.rel_file AS src, d.rel_file AS dst, CAST(count(*) AS DOUBLE) AS weight FROM far f JOIN defs d ON f.key = d.key GROUP BY 1, 2)"""


def hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rel = _rel_file()
    start = (1 + F.col("event_id") % 5).cast("int")
    return e.where("event_type = 'error'").select(rel.alias("file"), start.alias("start"), (start + F.col("event_id") % 3).cast("int").alias("end"))


HUNKS = """
hunks AS (SELECT DISTINCT p.rel_file AS file, CAST(1 + e.event_id % 5 AS INTEGER) AS "start", CAST(1 + e.event_id % 5 + e.event_id % 3 AS INTEGER) AS "end"
          FROM e JOIN p USING (event_id) WHERE e.event_type = 'error')"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id and a path: that of a tag with variants of ending and place."""
    endings = [".py", ".PB.GO", "/.env", "/.env.local", "/Makefile", ".json", ".TSX", ".mjs", ".rs", ".hpp", "_test.py", ".spec.ts", "/test/x.js", "/conftest.py", "/testdata/a.c", ".d.ts", "/node_modules/a.js", "\\tests\\b.java", "/.bashrc", ".md"]
    e = table(spark, sf_dir, "events")
    stem = F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string"), F.lit("/u"), F.col("user_id").cast("string"))
    return e.select("event_id", F.concat(stem, F.get(F.array(*[F.lit(x) for x in endings]), (F.col("event_id") % len(endings)).cast("int"))).alias("path"))


PATHS = r"""
paths AS (SELECT event_id, 'p' || (user_id % 7) || '/u' || user_id ||
  (['.py', '.PB.GO', '/.env', '/.env.local', '/Makefile', '.json', '.TSX', '.mjs', '.rs', '.hpp', '_test.py', '.spec.ts', '/test/x.js', '/conftest.py', '/testdata/a.c', '.d.ts', '/node_modules/a.js', '\tests\b.java', '/.bashrc', '.md'])[event_id % 20 + 1] AS path FROM events)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel_file, line, text of documents as files."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_file"), F.posexplode(F.split("text", "\n")).alias("p", "text")).select("rel_file", (F.col("p") + 1).alias("line"), "text")


LINES = r"""
lines AS (SELECT source || '/' || doc_id || '.txt' AS rel_file, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS line, unnest(string_split(text, chr(10))) AS text FROM documents)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, source, dest: a page as a file and a link in one of many forms."""
    forms = ["../a{}.md", "b{}.md#part", "#x{}", "pic{}.PNG", "https://x.org/{}", "[[U{}]]", "[[u{}|alias]]", "/abs/{}/c.md?q=1", "../../../{}.md", "mailto:a{}@b", "./d/../e{}.md", "//cdn/{}", "u{}", "x:{}"]
    p = table(spark, sf_dir, "pages")
    n = (F.col("page_id") % 9).cast("string")
    form = F.get(F.array(*[F.lit(f) for f in forms]), (F.col("page_id") % len(forms)).cast("int"))
    return p.select("page_id", F.concat(F.lit("docs/s"), (F.col("page_id") % 5).cast("string"), F.lit("/u"), n, F.lit(".md")).alias("source"), F.replace(form, F.lit("{}"), n).alias("dest"))


LINKS = """
links AS (SELECT page_id, 'docs/s' || (page_id % 5) || '/u' || (page_id % 9) || '.md' AS source,
  replace((['../a{}.md', 'b{}.md#part', '#x{}', 'pic{}.PNG', 'https://x.org/{}', '[[U{}]]', '[[u{}|alias]]', '/abs/{}/c.md?q=1', '../../../{}.md', 'mailto:a{}@b', './d/../e{}.md', '//cdn/{}', 'u{}', 'x:{}'])[page_id % 14 + 1], '{}', CAST(page_id % 9 AS VARCHAR)) AS dest FROM pages)"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the pages as Markdown: a heading and a link of each page."""
    of = links(spark, sf_dir).select("page_id", F.col("source").alias("rel_file"), "dest")
    row = F.explode(F.array(F.struct(F.lit("function").alias("kind"), F.concat(F.lit("Part "), (F.col("page_id") % 3).cast("string"), F.lit("!")).alias("name")), F.struct(F.lit("ref").alias("kind"), F.col("dest").alias("name")))).alias("t")
    line = F.col("page_id").cast("int")
    return of.select("rel_file", line.alias("line"), F.lit(0).alias("end_line"), row).select("rel_file", "line", "end_line", "t.name", "t.kind", F.lit("markdown").alias("lang"), F.col("line").alias("ord"))
