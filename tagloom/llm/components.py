"""Connected components of a graph given as edges, by alternating large-star and small-star contraction.

Each round is two grouped minima and joins over the remaining edges; nothing is collected.  The edges of each
round are a table in the shared folder, so a lost executor costs one round's partition and never the lineage.
"""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or smaller-or-equal) neighbours with the least node of its neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # every neighbour b < a, and a itself, to the least
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, rounds: int = 60, kept: list[str] | None = None) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node reachable.  ``edges``: columns a, b.

    The path of the last round's table, which the result reads, goes to ``kept``.
    """
    keep: list[str] = []
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), keep)
    seen = None
    for _ in range(rounds):
        mine: list[str] = []
        after = stored(_star(_star(now, True), False), mine)
        sign = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        discard(edges.sparkSession, keep)
        keep, now = mine, after
        if seen == (sign["n"], sign["h"]):
            break
        seen = (sign["n"], sign["h"])
    else:
        raise RuntimeError("components did not settle")
    if kept is not None:
        kept += keep
    else:
        atexit.register(discard, edges.sparkSession, keep)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
