"""What a change of a symbol can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Links, reach


def seeds(tags: DataFrame, symbol: str, file: str = "") -> DataFrame:
    own = tags.where((F.col("kind") != "ref") & (F.col("name") == symbol))
    return (own.where(F.col("rel_file") == file) if file else own).select("rel_file", "line")


def defined_in(tags: DataFrame, symbol: str, file: str = "") -> DataFrame:
    """``file:line`` of the first definition by (rel_file, line), '' without one."""
    first = seeds(tags, symbol, file).agg(F.min(F.struct("rel_file", "line")).alias("s"))
    return first.select(F.coalesce(F.concat_ws(":", F.col("s.rel_file"), F.col("s.line").cast("string")), F.lit("")).alias("defined_in"))


def dependents(tags: DataFrame, edge: DataFrame | Links, symbol: str, depth: int = 3, file: str = "") -> DataFrame:
    """file, symbol, line, depth: references in each reached file, or one row without a line where it has none."""
    reached = reach(edge, seeds(tags, symbol, file).select("rel_file"), depth).where("depth > 0")
    refs = tags.where((F.col("kind") == "ref") & (F.col("name") == symbol)).select("rel_file", "name", "line")
    return reached.join(refs, "rel_file", "left").select(F.col("rel_file").alias("file"), F.coalesce("name", F.lit("")).alias("symbol"), F.coalesce("line", F.lit(0)).alias("line"), "depth")


def blast_radius(tags: DataFrame, edge: DataFrame | Links, symbol: str, depth: int = 3, file: str = "") -> DataFrame:
    """One row: symbol, defined_in, direct and transitive dependents, total_files_affected."""
    rows = dependents(tags, edge, symbol, depth, file)
    entry = F.struct("file", "symbol", "line", "depth")
    picked = lambda c: F.sort_array(F.collect_list(F.when(c, entry)))
    found = rows.agg(picked(F.col("depth") == 1).alias("direct_dependents"), picked(F.col("depth") > 1).alias("transitive_dependents"), F.countDistinct("file").cast("int").alias("total_files_affected"))
    return defined_in(tags, symbol, file).crossJoin(found).select(F.lit(symbol).alias("symbol"), "defined_in", "direct_dependents", "transitive_dependents", "total_files_affected")
