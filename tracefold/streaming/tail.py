"""Keep an index up to date while logs grow.

Spark's own file streams read a file once. ``LogFiles`` is a stream of the files that are
new or have changed, its offset a map of their sizes and times; ``follow`` parses just those
files again, all files of a batch in one plan, and replaces their rows in a Parquet store that
``Index.load`` reads, one folder a file. A batch that runs twice leaves the same rows.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from ..sources.scan import REGISTRY


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, names: list[str]):
        self.root, self.names = root, names

    def _states(self) -> dict[str, list[int]]:
        found = {}
        for folder, _, files in os.walk(self.root):
            for name in files:
                if any(fnmatch.fnmatchcase(name, n) for n in self.names):
                    path = os.path.join(folder, name)
                    state = os.stat(path)
                    found[path] = [state.st_size, state.st_mtime_ns]
        return found

    def initialOffset(self) -> dict:
        return {"files": {}}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = self._states()
        return iter(self._changed(start, now)), {"files": now}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._changed(start, end["files"]))

    @staticmethod
    def _changed(start: dict, now: dict[str, list[int]]) -> list[tuple]:
        return [(p, s[0]) for p, s in sorted(now.items()) if start["files"].get(p) != s]


class LogFiles(DataSource):
    """Stream of ``(file_path, size)``; options ``root`` and ``names`` (globs, comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "log_files"

    def schema(self) -> str:
        return "file_path string, size bigint"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options["root"], self.options["names"].split(","))


def changed_files(spark: SparkSession, root: str, names: str) -> DataFrame:
    spark.dataSource.register(LogFiles)
    return spark.readStream.format("log_files").option("root", root).option("names", names).load()


def _remove(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def follow(spark: SparkSession, agent: str, root: str, store: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Parse files of one source as they change into ``store``/sessions, messages, tool_calls."""
    source = REGISTRY[agent]
    ordinal = list(REGISTRY).index(agent)
    file_key = F.left(F.sha2("file_path", 256), F.lit(32))

    def batch(changed: DataFrame, _: int) -> None:
        own = changed.sparkSession
        keys = {r["file_path"]: r["key"] for r in changed.select("file_path", file_key.alias("key")).collect()}
        if not keys:
            return
        index = source.parse(own, sorted(keys), ordinal)
        frames = {"sessions": index.sessions, "messages": index.messages, "tool_calls": index.tool_calls.withColumn("input", F.to_json("input"))}
        for name, frame in frames.items():
            _remove(own, [f"{store}/{name}/file_key={key}" for key in keys.values()])  # a file may have lost all its rows
            frame.withColumn("file_key", file_key).repartition("file_key").write.mode("append").partitionBy("file_key").parquet(f"{store}/{name}")

    writer = changed_files(spark, root, source.LAYOUT.names).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
