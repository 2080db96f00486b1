"""Definitions that nothing references, and files that nothing leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import columns as C

from .graph import Links, led_to

DEFAULT_MIN_RANK = 0.001
# Wording of the summary.
HIDDEN_SYMBOLS = " test symbols hidden; set include_test_symbols to show"
HIDDEN_ORPHANS = " test/docs orphans hidden; set include_test_orphans / include_doc_orphans to show"


def dead_candidates(tags: DataFrame, kinds: list[str] | None = None, unexported_only: bool = False, exported_only: bool = False) -> DataFrame:
    """Definitions whose bare name is no reference's, after the kind and visibility filters; with ``category``."""
    used = tags.where("kind = 'ref'").select("name").distinct()
    out = tags.where("kind <> 'ref'").join(used, "name", "left_anti")
    kinds = [k for k in kinds or [] if k]
    if kinds:
        out = out.where(F.col("kind").isin(*kinds))
    hidden = C.unexported(F.col("name"), F.col("lang"))
    if unexported_only:
        out = out.where(hidden)
    if exported_only:
        out = out.where(~hidden)
    return out.select("rel_file", "name", "line", "kind", C.category(F.col("rel_file")).alias("category"))


def dead_symbols(tags: DataFrame, include_tests: bool = False, **filters) -> DataFrame:
    out = dead_candidates(tags, **filters)
    return out if include_tests else out.where("category <> 'test'")


def hidden_tests(tags: DataFrame, **filters) -> DataFrame:
    """How many dead symbols the test filter hides: counted after all other filters."""
    return dead_candidates(tags, **filters).agg(F.count_if(F.col("category") == "test").alias("hidden_tests"))


def orphan_candidates(nodes: DataFrame, edge: DataFrame | Links, ranks: DataFrame, min_rank: float = DEFAULT_MIN_RANK) -> DataFrame:
    """Files without an incoming edge whose rank is at most ``min_rank``."""
    floor = min_rank if min_rank > 0 else DEFAULT_MIN_RANK
    alone = nodes.select("rel_file").join(led_to(edge), "rel_file", "left_anti")
    return (
        alone.join(ranks, "rel_file", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0))).where(F.col("rank") <= floor)
        .select("rel_file", "rank", C.lang_of(F.col("rel_file")).alias("lang"), C.category(F.col("rel_file")).alias("category"))
    )


def orphans(nodes, edge, ranks, min_rank: float = DEFAULT_MIN_RANK, include_tests: bool = False, include_docs: bool = False) -> DataFrame:
    out = orphan_candidates(nodes, edge, ranks, min_rank)
    out = out if include_tests else out.where("category <> 'test'")
    return out if include_docs else out.where("category <> 'docs'")


def summary(dead: DataFrame, orphan: DataFrame, include_tests: bool = False, include_docs: bool = False) -> DataFrame:
    """One row ``summary`` over unfiltered candidates: counts shown, then what the filters hide."""
    shown = F.count_if((F.col("category") != "test") | F.lit(include_tests))
    d = dead.agg(shown.alias("dead"), (F.count(F.lit(1)) - shown).alias("dead_tests"))
    seen = ((F.col("category") != "test") | F.lit(include_tests)) & ((F.col("category") != "docs") | F.lit(include_docs))
    o = orphan.agg(F.count_if(seen).alias("orphans"), (F.count(F.lit(1)) - F.count_if(seen)).alias("o_hidden"))

    def clause(n: str, text: str) -> Column:
        return F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(text)))

    parts = F.array_join(F.filter(F.array(clause("dead_tests", HIDDEN_SYMBOLS), clause("o_hidden", HIDDEN_ORPHANS)), lambda x: x.isNotNull()), "; ")
    return d.crossJoin(o).select(F.concat(F.format_string("%d dead symbols, %d orphan files", "dead", "orphans"), F.when(parts != "", F.concat(F.lit(" ("), parts, F.lit(")"))).otherwise("")).alias("summary"))
