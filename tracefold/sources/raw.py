"""Listing of log files and tolerant reading of their lines."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE


def expand_home(path: str) -> str:
    """A leading ``~`` or ``~/`` only."""
    import os

    return os.path.expanduser(path) if path == "~" or path.startswith("~/") else path


def configure(spark: SparkSession) -> None:
    """What reading depends on: UTC, and the last of duplicate JSON keys."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


@dataclass(frozen=True)
class Layout:
    """Where a source keeps its logs: folders below the root, and the files' names."""

    folders: str  # "" none, "*" one level, "**" any
    names: str  # glob


def plain(path: str) -> str:
    return path[5:].replace("//", "", 1) if path.startswith("file://") else path[5:] if path.startswith("file:") else path


def literal(path: str) -> str:
    """``path`` as a glob that matches just itself."""
    return re.sub(r"([\\{}\[\]*?,])", r"\\\1", path) if re.search(r"[\\{}\[\]*?]", path) else path


def list_files(spark: SparkSession, root: str, layout: Layout) -> list[str]:
    """Sorted paths; a missing root has none. Works on any file system Spark can read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(expand_home(root))
    fs = top.getFileSystem(conf)
    if not fs.exists(top):
        return []
    if layout.folders == "**":
        import fnmatch

        name = re.compile("|".join(fnmatch.translate(n) for n in layout.names.split(",")))
        walk, found = fs.listFiles(top, True), []
        while walk.hasNext():
            path = walk.next().getPath()
            if name.match(path.getName()):
                found.append(path.toString())
    else:
        pattern = "/".join(x for x in (literal(top.toString()), layout.folders, layout.names) if x)
        states = fs.globStatus(jvm.org.apache.hadoop.fs.Path(pattern)) or []
        found = [s.getPath().toString() for s in states if s.isFile()]
    return sorted(plain(p) for p in found)


def files_frame(spark: SparkSession, agent: str, agent_ord: int, paths: list[str]) -> DataFrame:
    rows = [(agent, agent_ord, p, i) for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, "agent string, agent_ord int, file_path string, file_ord int")


def read_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(file_path, value)``, whole files; files of no bytes have no row."""
    if not paths:
        return spark.createDataFrame([], "file_path string, value string")
    spark.catalog.refreshByPath(posixpath.commonpath(paths))  # logs grow: what is cached of them is stale
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    name = F.regexp_replace(F.regexp_replace(name, "^file:///", "/"), "^file:/(?!/)", "/")
    return spark.read.text([literal(p) for p in paths], wholetext=True).select(name.alias("file_path"), F.make_valid_utf8("value").alias("value"))


def lines_of(texts: DataFrame) -> DataFrame:
    """``(file_path, ord, line, v)``: trimmed lines that parse as JSON, in file order."""
    lines = texts.select("file_path", F.posexplode(F.split("value", "\n", -1)).alias("ord", "line"))
    trimmed = F.regexp_replace(F.regexp_replace("line", f"^{SPACE}+", ""), f"{SPACE}+$", "")
    parsed = lines.withColumn("line", trimmed).where("line <> ''").withColumn("v", F.try_parse_json("line"))
    return parsed.where("v is not null")


def count_matching(spark: SparkSession, root: str, names: str) -> int:
    return len(list_files(spark, root, Layout("**", names)))
