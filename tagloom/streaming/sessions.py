"""Change events: debouncing, formatting and streaming refresh of the relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def debounced(changes: DataFrame, ts: str = "ts", keys: list[str] | None = None, gap: str = "300 milliseconds") -> DataFrame:
    """Bursts of changes: a burst ends once ``gap`` passes without one.  Works on batches and, with a watermark, on streams."""
    out = changes.groupBy(*(keys or []), F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("changes"))
    return out.drop("w")


def changed_files(changes: DataFrame, gap: str = "300 milliseconds", late: str = "1 second") -> DataFrame:
    """project, window, files of each burst of a stream (ts, project, rel_file); each project has bursts of its own."""
    return changes.withWatermark("ts", late).groupBy("project", F.session_window("ts", gap).alias("window")).agg(F.collect_set("rel_file").alias("files"))


def event_line(events: DataFrame) -> Column:
    """HH:MM:SS, type in 20 places, project and k=v of events (ts, project, type, fields)."""
    fields = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return F.concat_ws(" ", F.date_format("ts", "HH:mm:ss"), F.rpad("type", 20, " "), F.nullif(F.col("project"), F.lit("")), fields)


def event_json(events: DataFrame, project: str = "") -> DataFrame:
    """One server-sent frame for each event of ``project`` (all, if empty)."""
    own = events.where(F.col("project") == project) if project else events
    flat = F.map_concat(F.create_map(F.lit("ts"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit("type"), F.col("type")), F.when(F.col("project") != "", F.create_map(F.lit("project"), F.col("project"))).otherwise(F.create_map().cast("map<string,string>")), F.col("fields"))
    return own.select(F.concat(F.lit("data: "), F.to_json(flat), F.lit("\n\n")).alias("frame"))


def refresh_stream(changes: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, gap: str = "300 milliseconds", late: str = "1 second"):
    """Start a query that calls ``refresh(files, batch)`` with the distinct (project, rel_file) of each closed burst.

    ``refresh`` re-reads those files, merges their tags and rebuilds graph and ranks; it must be idempotent, as a batch may be
    delivered again after a failure.
    """

    def handle(batch: DataFrame, number: int) -> None:
        refresh(batch.select("project", F.explode("files").alias("rel_file")).distinct(), number)

    return changed_files(changes, gap, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle).start()
