"""The tag cache of a tree: tags by file and modification time, kept as tables in a folder.

Below the folder each version of the extractors has a place of its own, so tags of another version are never read.  Each save is a
generation; it counts once its table of files is complete, which is written last, and older generations go after that.  One process
owns the folder at a time.
"""

from __future__ import annotations

import importlib.resources
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from tagloom.operators.cache import fingerprint
from tagloom.schema import TAG
from tagloom.scratch import discard

FILES = "rel_file string, mtime_ns bigint"


def version() -> str:
    """Fingerprint of the extractors' sources and of the schema of tags."""
    sources = [f for f in importlib.resources.files("tagloom.extract").iterdir() if f.name.endswith(".py")]
    return fingerprint(TAG.simpleString(), *(f"{f.name}\n{f.read_text()}" for f in sorted(sources, key=lambda f: f.name)))


class TagCache:
    def __init__(self, spark: SparkSession, folder: str, of: str = "") -> None:
        self.spark, self.place = spark, f"{folder.rstrip('/')}/{of or version()}"

    def _generations(self) -> list[str]:
        """Paths of complete generations, the newest last, and of nothing that a failed save has left."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(self.place)
        fs = place.getFileSystem(conf)
        if not fs.exists(place):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(place))
        return [f"{self.place}/{n}" for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.place}/{n}/files/_SUCCESS"))]

    def load(self) -> tuple[DataFrame, DataFrame]:
        """All cached files (rel_file, mtime_ns), those without a tag included, and all their tags; empty if there is no cache."""
        held = self._generations()
        if not held:
            return self.spark.createDataFrame([], FILES), self.spark.createDataFrame([], TAG)
        return self.spark.read.schema(FILES).parquet(f"{held[-1]}/files"), self.spark.read.schema(TAG).parquet(f"{held[-1]}/tags")

    def save(self, files: DataFrame, tags: DataFrame) -> None:
        """The cache is ``files`` and ``tags`` from now on; neither may be read from a table that ``load`` returned."""
        old = self._generations()
        path = f"{self.place}/{time.time_ns():020d}-{uuid.uuid4().hex}"
        tags.select(*TAG.names).write.parquet(f"{path}/tags")
        files.select("rel_file", "mtime_ns").write.parquet(f"{path}/files")
        discard(self.spark, old)
