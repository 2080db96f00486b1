"""The tag cache as a relation, incremental refresh, and project status."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BYTES_PER_TAG = 80
SCHEMA_VERSION = "tagloom-tags-1"


def fingerprint(*parts: str) -> str:
    """Version of the tag relation: what the extractors are.  Tables of other versions are never read."""
    return hashlib.sha256("\n".join((SCHEMA_VERSION, *parts)).encode()).hexdigest()


def split_hits(files: DataFrame, cache: DataFrame) -> DataFrame:
    """``files`` (rel_file, mtime_ns) with ``hit``: whether the cache holds the file at that time."""
    c = cache.select("rel_file", F.col("mtime_ns").alias("cached_ns"))
    return files.join(c, "rel_file", "left").select("rel_file", "mtime_ns", F.coalesce(F.col("cached_ns") == F.col("mtime_ns"), F.lit(False)).alias("hit"))


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    return cache.join(fresh.select("rel_file"), "rel_file", "left_anti").unionByName(fresh)


def invalidate(cache: DataFrame, gone: DataFrame) -> DataFrame:
    return cache.join(gone.select("rel_file"), "rel_file", "left_anti")


def refreshed(tags: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Tags after a batch of changed files: theirs go, those parsed anew come."""
    return tags.join(changed.select("rel_file").distinct(), "rel_file", "left_anti").unionByName(fresh)


def deduplicated(tags: DataFrame) -> DataFrame:
    """Per file the first tag of each (name, kind, line) by emission order; markdown keeps all.

    One pass over tags dealt out by file: what already lies so is not dealt out again.
    """
    mark = F.col("lang") == "markdown"
    w = Window.partitionBy("rel_file", "name", "kind", "line", "__mark").orderBy("ord", "end_line", "lang")
    ranked = tags.withColumn("__mark", mark).withColumn("__k", F.row_number().over(w))
    return ranked.where("__mark OR __k = 1").select("rel_file", "line", "end_line", "name", "kind", "lang", "ord")


def status(tags: DataFrame, project) -> DataFrame:
    """project, files, tags, memory_bytes."""
    return tags.groupBy(project.alias("project")).agg(F.countDistinct("rel_file").alias("files"), F.count(F.lit(1)).alias("tags"), (F.count(F.lit(1)) * BYTES_PER_TAG).alias("memory_bytes"))
