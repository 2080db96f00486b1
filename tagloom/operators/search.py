"""Searching names, and the ranked map of a project."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import columns as C


def search_identifiers(tags: DataFrame, query: str, filter: str = "both", limit: int = 50, kinds: list[str] | None = None) -> DataFrame:  # noqa: A002
    """Tags whose name holds ``query`` in any case, in the order (rel_file, line, ord)."""
    out = tags.where(F.contains(F.lower("name"), F.lit(query.lower())))
    if filter == "defs":
        out = out.where("kind <> 'ref'")
    elif filter == "refs":
        out = out.where("kind = 'ref'")
    kinds = [k for k in kinds or [] if k]
    if kinds:
        out = out.where(F.col("kind").isin(*kinds))
    return out.orderBy("rel_file", "line", "ord").limit(limit if limit > 0 else 50)


def matched(tags: DataFrame, query: str, refs: bool = False, include_tests: bool = False, path: str = "") -> DataFrame:
    """Tags outside Markdown whose name holds ``query`` in any case, with their class: 0 exact, 1 prefix, 2 inside."""
    q = query.strip().lower()
    name = F.lower("name")
    hit = tags.where((F.col("lang") != "markdown") & F.contains(name, F.lit(q)) & C.under(F.col("rel_file"), path))
    if not refs:
        hit = hit.where("kind <> 'ref'")
    if not include_tests:
        hit = hit.where(~C.is_test(F.col("rel_file")))
    return hit.withColumn("class", F.when(name == q, 0).when(F.startswith(name, F.lit(q)), 1).otherwise(2))


def search(tags: DataFrame, ranks: DataFrame, query: str, refs: bool = False, include_tests: bool = False, path: str = "", most: int = 0) -> DataFrame:
    """Hits with their class and place in the ranking.

    Places of all hits are one sorted run; an answer of at most ``most`` hits takes these by a distributed top-k first.
    """
    hit = matched(tags, query, refs, include_tests, path).join(ranks, "rel_file", "left")
    order = ["class", F.col("kind") == "ref", F.coalesce("rank", F.lit(0.0)).desc(), "rel_file", "line", "ord"]
    if most > 0:
        hit = hit.orderBy(*order).limit(most)
    return hit.select("class", "rel_file", "line", "end_line", "kind", "name", F.row_number().over(Window.orderBy(*order)).alias("place"))


def search_entries(hits: DataFrame) -> DataFrame:
    own = F.when(F.col("kind") == "ref", F.format_string("%s:%d ref %s\n", "rel_file", "line", "name")).otherwise(F.concat(F.col("rel_file"), F.lit(":"), C.span(F.col("line"), F.col("end_line")), F.lit(" "), F.col("kind"), F.lit(" "), F.col("name"), F.lit("\n")))
    return hits.select("place", own.alias("entry"))


def within_budget(entries: DataFrame, order: str, used: int, most: int, reserve: int) -> DataFrame:
    """The longest prefix of ``entries`` whose token estimates fit: a running sum, cut at the first overflow.

    No entry costs less than a token, so only ``most`` of them can fit and the sum runs over no more.
    """
    entries = entries.orderBy(order).limit(most)
    w = Window.orderBy(order)
    return entries.withColumn("tokens", F.sum(C.estimate_tokens(F.col("entry"))).over(w)).where(F.col("tokens") + used + reserve <= most)


def map_sections(tags: DataFrame, ranks: DataFrame) -> DataFrame:
    """rel_file, rank and the text section of each file with definitions."""
    line = F.struct("line", "ord", F.format_string("  %d: %s\n", "line", "name").alias("t"))
    body = tags.where("kind <> 'ref'").groupBy("rel_file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["t"]), "").alias("body"))
    out = body.join(ranks, "rel_file", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    return out.select("rel_file", "rank", F.concat(F.format_string("%s:\n(Rank: %.2f)\n", F.col("rel_file"), F.col("rank") * 100), F.col("body"), F.lit("⋮...\n")).alias("section"))


def repo_map(sections: DataFrame, budget: int = 8192) -> DataFrame:
    """The files of the map, by rank then path, up to the first section that overflows; the first always stays.

    A section takes at least 4 bytes a token, so only that many best files can matter: they are picked by a
    distributed top-k before the running sum, which is global.
    """
    budget = budget if budget > 0 else 8192
    best = sections.orderBy(F.col("rank").desc(), "rel_file").limit(budget)
    w = Window.orderBy(F.col("rank").desc(), "rel_file")
    out = best.withColumn("bytes", F.sum(F.octet_length("section")).over(w)).withColumn("place", F.row_number().over(w))
    return out.where((F.floor(F.col("bytes") / 4) <= budget) | (F.col("place") == 1)).select("place", "rel_file", "section")
