"""Diffs and the symbols they touch."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import columns as C

from .graph import Links
from .walks import reach_sizes

_REF = re.compile(r"[a-zA-Z0-9._~^/\-]+")


def parse_diff(diffs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """file, start, end of each hunk's new side; ``diffs`` has the column ``diff`` and any ``key`` columns.

    Lines are numbered within their diff and the file name is carried forward by a window over the diff alone.
    """
    key = key or []
    rows = diffs.select(*key, F.posexplode(F.split("diff", "\n")).alias("pos", "l"))
    name = F.regexp_replace(C.strip(F.substring("l", 5, 1 << 20)), r"\Ab/", "")
    name = F.substring_index(name, "\t", 1)
    mark = (
        F.when(F.col("l").startswith("diff --git "), "")
        .when(F.col("l").startswith("+++ "), F.when(name == "/dev/null", "").otherwise(name))
    )
    carried = rows.withColumn("file", F.last(mark, True).over(Window.partitionBy(*(key or [F.lit(0)])).orderBy("pos")))
    hunk = r"\A@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    start = F.regexp_extract("l", hunk, 1).cast("int")
    many = F.regexp_extract("l", hunk, 2)
    size = F.when(many == "", 1).otherwise(many.try_cast("int"))
    return carried.where(F.col("l").rlike(hunk) & (F.col("file") != "")).select(*key, "file", start.alias("start"), (start + F.greatest(size - 1, F.lit(0))).alias("end"))


def git_diff(root: str, ref: str) -> str:
    """Text of ``git diff ref HEAD``, with nothing of the user's own configuration run."""
    if not _REF.fullmatch(ref) or ref.startswith("-"):
        raise ValueError(f"invalid git ref {ref!r}")
    return subprocess.run(["git", "-c", "core.fsmonitor=false", "diff", "--no-ext-diff", "--no-textconv", "--no-color", "--unified=0", "--end-of-options", ref, "HEAD"], cwd=root, capture_output=True, text=True, check=True).stdout


def _spans(tags: DataFrame) -> DataFrame:
    return tags.where("kind <> 'ref'").select("rel_file", "name", "kind", "line", F.greatest("end_line", "line").alias("end_line"), "ord")


def touched(tags: DataFrame, hunks: DataFrame) -> DataFrame:
    """Definition and hunk pairs that overlap: an interval join that always carries the file as equality."""
    h = hunks.select(F.col("file").alias("rel_file"), "start", "end").distinct()
    return _spans(tags).join(h, "rel_file").where("start <= end_line AND end >= line")


def changed_symbols(tags: DataFrame, hunks: DataFrame) -> DataFrame:
    """file, symbol, line, kind, reason of the innermost definitions that hunks touch.

    A definition whose own line is untouched stays only if some hunk on it hits no strictly inner touched definition.
    """
    pairs = touched(tags, hunks)
    inner = pairs.select("rel_file", "start", "end", F.col("line").alias("il"), F.col("end_line").alias("ie"))
    ident = ["rel_file", "name", "kind", "line", "end_line", "ord"]
    covered = (
        pairs.join(inner, ["rel_file", "start", "end"])
        .where("il >= line AND ie <= end_line AND (il > line OR ie < end_line)")
        .select(*ident, "start", "end").distinct()
    )
    free = pairs.join(covered, [*ident, "start", "end"], "left_anti").select(*ident).distinct().withColumn("free", F.lit(True))
    hit = pairs.groupBy(*ident).agg(F.max((F.col("line") >= F.col("start")) & (F.col("line") <= F.col("end"))).alias("own"))
    kept = hit.join(free, ident, "left").where("own OR free")
    return kept.select(F.col("rel_file").alias("file"), F.col("name").alias("symbol"), "line", "kind", F.when(F.col("own"), "definition").otherwise("body").alias("reason"))


def changed_blast(tags: DataFrame, edge: DataFrame | Links, changed: DataFrame, depth: int = 3) -> DataFrame:
    """symbol, file, total_files_affected of each changed symbol: what a file can reach is counted once for all its symbols."""
    keys = changed.select("symbol", "file").distinct()
    defs = tags.where("kind <> 'ref'").select(F.col("name").alias("symbol"), F.col("rel_file").alias("file")).distinct()
    start = keys.join(defs, ["symbol", "file"])
    hit = start.join(reach_sizes(edge, start.select(F.col("file").alias("rel_file")), depth).withColumnRenamed("rel_file", "file"), "file").select("symbol", "file", "n")
    return keys.join(hit, ["symbol", "file"], "left").select("symbol", "file", F.coalesce("n", F.lit(0)).alias("total_files_affected"))


def summary(changed: DataFrame, hunks: DataFrame) -> DataFrame:
    """One row ``summary``; files are those of the diff, touched definitions or not."""
    c = changed.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason") == "body").alias("b"))
    f = hunks.agg(F.countDistinct("file").alias("f"))
    tail = F.when(F.col("b") > 0, F.format_string(" (%d attributed to enclosing definitions)", "b")).otherwise("")
    return c.crossJoin(f).select(F.concat(F.format_string("%d changed symbols across %d files", "n", "f"), tail).alias("summary"))
