"""Working tables in the folder that all machines share.

A table written there cuts the lineage of loops and survives lost executors.  Whoever stores one owns its path: it is appended to
``keep`` and goes with ``discard``; what nobody discards goes when the session's process ends.
"""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or its checkpoint folder; a local one only where master and executors are one machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return _local()


@functools.cache
def _local() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tagloom-")


def stored(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``df`` written as a table and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tagloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if keep is None:
        atexit.register(discard, spark, [path])
    else:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete the tables and empty the list."""
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    try:
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone at exit; the folder is scratch
        return
    paths.clear()
