"""Trees of files as relations: listing, safe reads and the parse step."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.extract import extract
from tagloom.functions import columns as C
from tagloom.schema import TAG

from .ignore import Ignore

MAX_BYTES = 8 << 20


def inside(rel: str) -> bool:
    """Whether a relative path stays within its root, by its text alone."""
    if not rel or os.path.isabs(rel):
        return False
    clean = os.path.normpath(rel)
    return clean not in (".", "..") and not clean.startswith("../")


def read_regular(root: str, rel: str, most: int = MAX_BYTES) -> bytes:
    """Content of a regular file below ``root``; links, other kinds, larger files and files that change meanwhile are refused."""
    if not inside(rel):
        raise ValueError(f"{rel!r} lies outside the root")
    path = os.path.join(root, rel)
    if os.path.realpath(os.path.dirname(path)) != os.path.normpath(os.path.join(os.path.realpath(root), os.path.dirname(rel))):
        raise ValueError(f"{rel!r} leads through a link")
    fd = os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
    with os.fdopen(fd, "rb") as f:
        info = os.fstat(fd)
        if not stat.S_ISREG(info.st_mode) or info.st_size > most:
            raise ValueError(f"{rel!r} is no regular file of at most {most} bytes")
        data = f.read(most + 1)
        after = os.lstat(path)
        if (after.st_ino, after.st_dev) != (info.st_ino, info.st_dev) or len(data) > most:
            raise ValueError(f"{rel!r} changed while it was read")
    return data


def read_head(root: str, rel: str, n: int = 256) -> bytes:
    with os.fdopen(os.open(os.path.join(root, rel), os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK), "rb") as f:
        return f.read(n)


def list_tree(root: str, ignore: Ignore | None = None) -> Iterator[tuple[str, int, int]]:
    """(rel_file, size, mtime_ns) of every regular file that is not ignored, in lexical order; ignored folders are not entered."""
    ignore = ignore or Ignore.of_tree(root)

    def walk(folder: str, prefix: str):
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            rel = prefix + entry.name
            info = entry.stat(follow_symlinks=False)
            if stat.S_ISDIR(info.st_mode):
                if not ignore(rel, True):
                    yield from walk(entry.path, rel + "/")
            elif stat.S_ISREG(info.st_mode) and not ignore(rel):
                yield rel, info.st_size, info.st_mtime_ns

    yield from walk(root, "")


def tree_files(spark: SparkSession, root: str) -> DataFrame:
    """rel_file, size, mtime_ns of a local tree."""
    return spark.createDataFrame(list(list_tree(root)), "rel_file string, size bigint, mtime_ns bigint")


def tree_contents(files: DataFrame, root: str) -> DataFrame:
    """rel_file, content of files that may be source, read by the tasks; unreadable ones are left out."""

    def read(frames):
        for pdf in frames:
            rows = []
            for rel in pdf["rel_file"]:
                try:
                    rows.append((rel, read_regular(root, rel)))
                except (OSError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["rel_file", "content"])

    spark = files.sparkSession
    wide = files.where(C.maybe_source(F.col("rel_file"))).select("rel_file").repartition(max(1, spark.sparkContext.defaultParallelism))
    return wide.mapInPandas(read, "rel_file string, content binary")


def store_contents(spark: SparkSession, path: str) -> DataFrame:
    """rel_file, size, mtime_ns, content of a tree in any store Spark reads; size and name filters reach the listing."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= MAX_BYTES)
    rel = F.regexp_replace(F.regexp_replace("path", r"\A[a-z]+:/*", "/"), r"\A\Q" + "/" + path.split(":", 1)[-1].strip("/") + r"\E/*", "")
    return raw.select(rel.alias("rel_file"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content").where(~C.ignored_by_default(rel))


def parse(contents: DataFrame) -> DataFrame:
    """Tags of (rel_file, content): language by name or shebang, then the language's extractor; soft on errors."""
    head = F.make_valid_utf8(F.substring("content", 1, 256).cast("string"))
    typed = contents.select("rel_file", C.detect_lang(F.col("rel_file"), head).alias("lang"), "content").where("lang <> ''")

    def run(frames):
        for pdf in frames:
            rows = []
            for rel, lang, content in zip(pdf["rel_file"], pdf["lang"], pdf["content"], strict=True):
                text = bytes(content).decode("utf-8", "replace")
                rows += [(rel, line, end, name, kind, lang, i) for i, (line, end, name, kind) in enumerate(extract(text, lang))]
            yield pd.DataFrame(rows, columns=TAG.names).astype({"line": "int32", "end_line": "int32", "ord": "int32"})

    return typed.mapInPandas(run, TAG)


def lines_of(contents: DataFrame) -> DataFrame:
    """rel_file, line, text; a trailing empty line is none.  Bytes that are no UTF-8 become U+FFFD."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    rows = contents.select("rel_file", F.split(text, "\n").alias("l")).select("rel_file", F.size("l").alias("n"), F.posexplode("l").alias("p", "text"))
    return rows.where(~((F.col("p") == F.col("n") - 1) & (F.col("text") == ""))).select("rel_file", (F.col("p") + 1).alias("line"), "text")
