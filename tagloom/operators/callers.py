"""Who refers to a symbol: enclosing scopes, sites, text hits and callers of callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import columns as C
from tagloom.schema import SCOPE_KINDS
from tagloom.scratch import discard, stored


TEXT_GREP_MAX_BYTES = 1 << 20


BIN = 64


def binned(scopes: DataFrame, line: str, end: str) -> DataFrame:
    """``scopes`` once for each bin of ``BIN`` lines they touch: a line meets them in its own bin only, so a join on file and bin
    holds a line against what starts near it or runs over it, never against all of a long file."""
    return scopes.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(line) / BIN), F.floor(F.greatest(line, end) / BIN))))


def enclosing(sites: DataFrame, tags: DataFrame) -> DataFrame:
    """``sites`` (rel_file, line, ...) with scope, fn_name, fn_kind, fn_line, fn_end of the innermost definition around each.

    An interval join on equal files and bins of lines; the latest start wins, then the earliest end.  Functions are qualified
    by the innermost class strictly around them.  Sites outside any definition keep nulls.
    """
    scopes = tags.where(F.col("kind").isin(*SCOPE_KINDS))
    cls = scopes.where("kind = 'class'").select("rel_file", F.col("name").alias("c_name"), F.col("line").alias("c_line"), F.col("end_line").alias("c_end"), F.col("ord").alias("c_ord"))
    fn = scopes.select("rel_file", F.col("name").alias("fn_name"), F.col("kind").alias("fn_kind"), F.col("line").alias("fn_line"), F.col("end_line").alias("fn_end"), F.col("ord").alias("fn_ord"))
    strictly = "fn_kind <> 'class' AND c_line <= fn_line AND c_end >= fn_end AND (c_line < fn_line OR c_end > fn_end)"
    inside = (
        fn.withColumn("__bin", F.floor(F.col("fn_line") / BIN)).join(binned(cls, "c_line", "c_end"), ["rel_file", "__bin"]).where(strictly)
        .groupBy("rel_file", "fn_ord", "fn_line", "fn_name").agg(F.max(F.struct("c_line", -F.col("c_ord"), "c_name")).alias("c"))
    )
    around = fn.join(inside, ["rel_file", "fn_ord", "fn_line", "fn_name"], "left").withColumn("scope", F.when(F.col("c").isNotNull(), F.concat(F.col("c.c_name"), F.lit("."), F.col("fn_name"))).otherwise(F.col("fn_name"))).drop("c")
    keys = sites.columns
    hit = sites.withColumn("__bin", F.floor(F.col("line") / BIN)).join(binned(around, "fn_line", "fn_end"), ["rel_file", "__bin"]).where("fn_line <= line AND fn_end >= line")
    best = hit.groupBy(*keys).agg(F.max(F.struct("fn_line", (-F.col("fn_end")).alias("e"), (-F.col("fn_ord")).alias("o"), "scope", "fn_name", "fn_kind", "fn_end")).alias("b"))
    best = best.select(*keys, F.col("b.scope"), F.col("b.fn_name"), F.col("b.fn_kind"), F.col("b.fn_line"), F.col("b.fn_end"))
    return sites.join(best, keys, "left")


def def_files(tags: DataFrame) -> DataFrame:
    """Distinct (name, def_file) of definitions outside markdown."""
    return tags.where("kind <> 'ref' AND lang <> 'markdown'").select("name", F.col("rel_file").alias("def_file")).distinct()


def module_of(path: Column) -> Column:
    base = C.base_name(path)
    return F.regexp_replace(base, r"\.[^.]*\z", "")


def ref_sites(tags: DataFrame, lines: DataFrame | None, wanted: DataFrame, path: str = "", include_tests: bool = False) -> DataFrame:
    """Distinct sites of all ``wanted`` (name, origin) at once: name, origin, rel_file, line, status.

    status is ``elsewhere`` where the reference belongs to another definition than that in ``origin``, ``test`` where it
    is hidden as a test, else ``shown``.  A reference belongs elsewhere if its own file defines the name, or its line writes
    ``module.name`` with the module of another defining file; both need two defining files and an origin.
    """
    refs = tags.where("kind = 'ref' AND lang <> 'markdown'").where(C.under(F.col("rel_file"), path)).select("name", "rel_file", "line").distinct()
    sites = refs.join(wanted, "name")
    defs = wanted.join(def_files(tags), "name")
    # sets stay rows and meet the sites by equality: a row with all files of a name would cost the square of them
    several = defs.groupBy("name", "origin").agg((F.count(F.lit(1)) >= 2).alias("__several")).where("__several AND origin <> ''")
    own = defs.select("name", "origin", F.col("def_file").alias("rel_file"), F.lit(True).alias("__own"))
    sites = sites.join(several, ["name", "origin"], "left").join(own, ["name", "origin", "rel_file"], "left")
    elsewhere = F.col("__own").isNotNull()
    if lines is not None:
        text = lines.select("rel_file", "line", F.col("text").alias("__text"))
        mods = defs.where("def_file <> origin").select("name", "origin", module_of(F.col("def_file")).alias("__mod")).where(F.col("__mod") != module_of(F.col("origin"))).distinct()
        written = F.expr("regexp_extract_all(__text, concat('([A-Za-z_][A-Za-z0-9_]*)\\\\s*\\\\.\\\\s*\\\\Q', name, '\\\\E\\\\b'), 1)")
        site = ["name", "origin", "rel_file", "line"]
        named = sites.where("__several").select(*site).join(text, ["rel_file", "line"]).select(*site, F.explode(written).alias("__mod"))
        named = named.join(mods, ["name", "origin", "__mod"]).select(*site).distinct().withColumn("__named", F.lit(True))
        sites = sites.join(named, site, "left")
        elsewhere = elsewhere | F.col("__named").isNotNull()
    status = F.when(F.col("__several").isNotNull() & (F.col("rel_file") != F.col("origin")) & elsewhere, "elsewhere")
    if not include_tests:
        status = status.when(C.is_test(F.col("rel_file")), "test")
    return sites.select("name", "origin", "rel_file", "line", status.otherwise("shown").alias("status"))


def mentions(tags: DataFrame, lines: DataFrame, name: str, path: str = "", include_tests: bool = False) -> DataFrame:
    """Lines of parsed files that hold the name as a word but no tag of it: rel_file, line, hidden."""
    tagged = tags.where(F.col("name") == name).select("rel_file", "line")
    parsed = tags.groupBy("rel_file").agg(F.min_by("lang", "ord").alias("lang")).where("lang <> 'markdown'").select("rel_file")
    hit = lines.where(C.under(F.col("rel_file"), path) & C.has_word(F.col("text"), name))
    out = hit.join(parsed, "rel_file", "left_semi").join(tagged, ["rel_file", "line"], "left_anti")
    return out.select("rel_file", "line", (C.is_test(F.col("rel_file")) & F.lit(not include_tests)).alias("hidden"))


def text_sites(tags: DataFrame, files: DataFrame, lines: DataFrame, name: str, path: str = "", include_tests: bool = False) -> DataFrame:
    """Whole-word lines of files that are not parsed: rel_file, line, text, hidden."""
    plain = files.where((F.col("size") > 0) & (F.col("size") <= TEXT_GREP_MAX_BYTES) & (C.lang_of(F.col("rel_file")) == "") & C.under(F.col("rel_file"), path)).join(tags.select("rel_file").distinct(), "rel_file", "left_anti")
    hit = lines.where(C.has_word(F.col("text"), name)).join(plain.select("rel_file"), "rel_file", "left_semi")
    return hit.select("rel_file", "line", C.clip(F.col("text")).alias("text"), (C.is_test(F.col("rel_file")) & F.lit(not include_tests)).alias("hidden"))


def caller_name(fn_name: Column, scope: Column) -> Column:
    """The name the next level asks for: the function, or the class of a constructor; null for none."""
    cls = F.when(scope.contains("."), F.substring_index(scope, ".", 1))
    return F.when(fn_name.isin("__init__", "constructor", "__new__"), cls).otherwise(fn_name)


def callers(tags: DataFrame, lines: DataFrame | None, symbol: str, file: str = "", depth: int = 1, path: str = "", include_tests: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Sites of each level: depth, name, origin, rel_file, line, scope, fn_*, status.

    status adds ``ambiguous``: a by-name match of a method that other files define too, which is listed and not followed.
    """
    spark = tags.sparkSession
    depth = min(max(depth, 1), 3)
    origin = C.norm_path(file)
    if not origin:
        owners = def_files(tags).where(F.col("name") == symbol).select("def_file").limit(2).collect()
        origin = owners[0][0] if len(owners) == 1 else ""
    wanted = spark.createDataFrame([(symbol, origin, "", False)], "name string, origin string, cls string, method boolean")
    done = wanted.select("name")
    out, mine = None, []
    for d in range(1, depth + 1):
        level = ref_sites(tags, lines, wanted.select("name", "origin"), path, include_tests)
        shown = enclosing(level.where("status = 'shown'"), tags)
        rest = level.where("status <> 'shown'").select(*level.columns, *[F.lit(None).cast(shown.schema[c].dataType).alias(c) for c in ("scope", "fn_name", "fn_kind", "fn_line", "fn_end")])
        if d > 1:
            many = def_files(tags).groupBy("name").agg(F.count(F.lit(1)).alias("defs"))
            shown = shown.join(wanted, ["name", "origin"]).join(many, "name", "left")
            strict = F.col("method") & (F.coalesce("defs", F.lit(0)) > 1) & (F.col("rel_file") != F.col("origin"))
            if lines is not None:
                shown = shown.join(lines.select("rel_file", "line", F.col("text").alias("__text")), ["rel_file", "line"], "left")
                strict = strict & ~F.coalesce(F.expr("__text rlike concat('(^|[^A-Za-z0-9_])\\\\Q', cls, '.', name, '\\\\E(\\\\z|[^A-Za-z0-9_])')"), F.lit(False))
            shown = shown.withColumn("status", F.when(F.coalesce(strict, F.lit(False)), "ambiguous").otherwise(F.col("status"))).select(*rest.columns)
        now = stored(shown.select(*rest.columns).union(rest).withColumn("depth", F.lit(d)), mine)
        out = now if out is None else out.union(now)
        if d == depth:
            break
        ask = now.where("status = 'shown'").withColumn("next", caller_name(F.col("fn_name"), F.col("scope"))).where("next IS NOT NULL AND next <> ''")
        # the last site of a name, by file and line, is where its origin is taken from
        last = ask.groupBy("next").agg(F.max(F.struct("rel_file", "line", "scope", "fn_kind")).alias("s"))
        method = (F.col("s.fn_kind") != "class") & F.col("s.scope").contains(".")
        wanted = stored(last.select(F.col("next").alias("name"), F.col("s.rel_file").alias("origin"), F.when(method, F.regexp_replace(F.col("s.scope"), r"\.[^.]*\z", "")).otherwise("").alias("cls"), method.alias("method")).join(done, "name", "left_anti"), mine)
        done = done.union(wanted.select("name"))
    out = stored(out, keep)
    discard(spark, mine)
    return out


def with_context(sites: DataFrame, lines: DataFrame, context: int) -> DataFrame:
    """Lines around each site: rel_file, site, line, text, mark."""
    c = min(max(context, 0), 3)
    near = sites.select("rel_file", F.col("line").alias("site")).distinct().select("rel_file", "site", F.explode(F.sequence(F.col("site") - c, F.col("site") + c)).alias("line"))
    return near.join(lines, ["rel_file", "line"]).select("rel_file", "site", "line", C.clip(F.col("text")).alias("text"), F.when(F.col("line") == F.col("site"), ">").otherwise(" ").alias("mark"))
