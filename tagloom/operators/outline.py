"""Outlines of files and directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import columns as C
from tagloom.schema import OUTLINE_KINDS, SCOPE_KINDS

from .callers import BIN, binned

MOST_DEFS = 12


def kept(tags: DataFrame, all_kinds: bool = False) -> DataFrame:
    out = tags.where("kind <> 'ref' AND lang <> 'markdown'")
    return out if all_kinds else out.where(F.col("kind").isin(*OUTLINE_KINDS))


def file_outline(tags: DataFrame, all_kinds: bool = False) -> DataFrame:
    """rel_file, line, end_line, kind, name, depth: how many multi-line scopes that come before still run at its line.

    For properly nested spans this is the depth of a stack of open scopes.
    """
    defs = kept(tags, all_kinds).select("rel_file", "line", "end_line", "kind", "name", "ord")
    outer = defs.where(F.col("kind").isin(*SCOPE_KINDS) & (F.col("end_line") > F.col("line"))).select("rel_file", F.col("line").alias("ol"), F.col("end_line").alias("oe"), F.col("ord").alias("oo"))
    before = (F.col("ol") < F.col("line")) | ((F.col("ol") == F.col("line")) & ((F.col("oe") > F.col("end_line")) | ((F.col("oe") == F.col("end_line")) & (F.col("oo") < F.col("ord")))))
    at = defs.withColumn("__bin", F.floor(F.col("line") / BIN))
    pairs = at.join(binned(outer, "ol", "oe"), ["rel_file", "__bin"]).where(before & (F.col("oe") >= F.col("line")))
    count = pairs.groupBy("rel_file", "ord").agg(F.count(F.lit(1)).cast("int").alias("depth"))
    return defs.join(count, ["rel_file", "ord"], "left").select("rel_file", "line", "end_line", "kind", "name", F.coalesce("depth", F.lit(0)).alias("depth"))


def top_level(tags: DataFrame, all_kinds: bool = False) -> DataFrame:
    """Definitions inside no other kept multi-line scope, with their place in the file."""
    defs = kept(tags, all_kinds).select("rel_file", "line", "end_line", "kind", "name", "ord")
    outer = defs.where(F.col("kind").isin(*SCOPE_KINDS) & (F.col("end_line") > F.col("line"))).select("rel_file", F.col("line").alias("ol"), F.col("end_line").alias("oe"))
    inside = defs.join(outer, "rel_file").where("(ol < line AND oe >= end_line) OR (ol = line AND oe > end_line)").select("rel_file", "ord").distinct()
    w = Window.partitionBy("rel_file").orderBy("line", "ord")
    return defs.join(inside, ["rel_file", "ord"], "left_anti").withColumn("place", F.row_number().over(w))


def directory_entries(tags: DataFrame, counts: DataFrame, all_kinds: bool = False) -> DataFrame:
    """rel_file and its one-line entry: line count and the first top-level definitions."""
    name = F.when(F.col("kind").isin("class", "interface", "type"), F.concat(F.col("kind"), F.lit(" "), F.col("name"))).otherwise(F.col("name"))
    item = F.struct("place", F.concat(name, F.lit(" "), F.col("line").cast("string")).alias("t"))
    top = top_level(tags, all_kinds).groupBy("rel_file").agg(F.sort_array(F.collect_list(F.when(F.col("place") <= MOST_DEFS, item))).alias("items"), F.count(F.lit(1)).alias("n"))
    more = F.when(F.col("n") > MOST_DEFS, F.concat(F.lit(", +"), (F.col("n") - MOST_DEFS).cast("string"), F.lit(" more"))).otherwise("")
    names = F.coalesce(F.array_join(F.transform("items", lambda x: x["t"]), ", "), F.lit(""))
    files = tags.select("rel_file").distinct().join(top, "rel_file", "left").join(counts, "rel_file", "left")
    return files.select("rel_file", F.concat(F.col("rel_file"), F.lit(" ("), F.coalesce("n_lines", F.lit(0)).cast("string"), F.lit(" lines): "), names, F.coalesce(more, F.lit("")), F.lit("\n")).alias("entry"))


def chosen(entries: DataFrame, ranks: DataFrame, used: int, most: int, reserve: int = 60) -> DataFrame:
    """Files of a directory outline: by rank, each that still fits is taken and others are passed over.

    The fold is sequential, so it runs over a top-k that is known to hold every file that can fit: an entry has at least
    one token, hence no more than ``most`` files; smaller entries of lower rank are kept apart by token count.
    """
    sized = entries.join(ranks, "rel_file", "left").select("rel_file", "entry", F.coalesce("rank", F.lit(0.0)).alias("rank"), C.estimate_tokens(F.col("entry")).alias("t")).where(F.col("t") + used + reserve <= most)
    # of each size, no more than fit alone can be taken: the best of them by rank
    w = Window.partitionBy("t").orderBy(F.col("rank").desc(), "rel_file")
    able = sized.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).where(F.col("k") * F.col("t") <= most)  # the first bound is applied before the shuffle
    listed = able.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("r"), "rel_file", "t"))).alias("x"))
    first = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("files"))

    def take(a, x):
        fits = a["used"] + x["t"] + used + reserve <= most
        return F.when(fits, F.struct((a["used"] + x["t"]).alias("used"), F.concat(a["files"], F.array(x["rel_file"])).alias("files"))).otherwise(a)

    return listed.select(F.explode(F.aggregate("x", first, take, lambda a: a["files"])).alias("rel_file")).join(entries, "rel_file").orderBy("rel_file")


def line_counts(files: DataFrame) -> DataFrame:
    """rel_file, n_lines of (rel_file, text); a trailing empty line does not count."""
    lines = F.split("text", "\n")
    return files.select("rel_file", (F.size(lines) - F.when(F.element_at(lines, -1) == "", 1).otherwise(0)).alias("n_lines"))
