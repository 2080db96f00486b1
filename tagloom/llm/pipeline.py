"""Corpus pipeline: quality, near-duplicates, benchmark decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the columns of ``documents``.
Stages share nothing: a stage appends the paths of the working tables that its result still reads to ``kept``, and ``run``
deletes them once that result has been written.  Without a list they stay until the session's process ends.

Edge cases, in every stage: an empty table gives no rows.  Null and empty texts are scored like any other, are near copies
of each other, hold no benchmark item and no secret, and are repeated by their id.  Null ids are kept as rows of their own, and
are the last to stand for a group.  Fully repeated rows are near copies, so one stays.  Other columns pass through; names with
two leading underscores are the stages' own.
"""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, mixing, quality, secrets, simhash
from .common import discard, stored, table

ORACLE_SQL = None  # fitted scores, fingerprints and edit distances are beyond SQL; tests use brute force


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, kept: list[str] | None = None) -> DataFrame:
    """Documents that the classifier accepts (score of 0.7 or more)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, "__quality").where(F.col("__quality") >= quality.CUT).drop("__quality")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, kept: list[str] | None = None) -> DataFrame:
    """The document of least id of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more)."""
    return simhash.one_of_each(docs, k=5, kept=kept)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, kept: list[str] | None = None) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, kept: list[str] | None = None) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redacted(docs, kept=kept)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, kept: list[str] | None = None) -> DataFrame:
    """Documents repeated to the target weights of their sources, in global random order."""
    return mixing.replicate(docs, kept=kept)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for _, stage in STAGES[:-1]:
        kept, after = [], []
        docs = stored(stage(spark, docs, sf_dir, kept), after)
        discard(spark, kept + before)
        before = after
    atexit.register(discard, spark, before)  # the last stage's result reads them
    return STAGES[-1][1](spark, docs, sf_dir)
