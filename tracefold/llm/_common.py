"""Scratch tables, row keys and graph components shared by the operators.

Scratch tables are Parquet files under ``spark.checkpoint.dir``, which the driver
and all executors share, so a lost executor costs a re-read and never a wrong row.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def text_of(column: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(names: list[str], taken: list[str]) -> list[str]:
    """``names`` but for those that an operator's own output columns replace, whatever their case."""
    low = {t.lower() for t in taken}
    return [n for n in names if n.lower() not in low]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(names: list[str], into: str = "row") -> Column:
    """The named columns as one struct, out of reach of the names that a plan gives its own columns."""
    return F.struct(*(column(n).alias(n) for n in names) if names else [F.lit(0).alias("none")]).alias(into)


def unpacked(names: list[str], struct: str = "row") -> list[Column]:
    return [F.col(struct).getField(n).alias(n) for n in names]


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only on a single machine without."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tracefold-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: lineage ends at durable files.

    The shuffles of the write go with it. The folder of the application goes when its driver
    ends.
    """
    spark = df.sparkSession
    top = scratch_dir(spark)
    path = f"{top}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_saved(df: DataFrame) -> None:
    """Delete a scratch table that no later plan reads."""
    path, spark = df._scratch_path, df.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


ROW = ["row1", "row2"]


def row_key(docs: DataFrame) -> list[Column]:
    """``ROW``: a 128-bit hash of all columns, an identity that any rerun finds again.

    Rows that agree in every column share it. Types that can't be hashed go through JSON.
    """
    columns = []
    for f in docs.schema.fields:
        kind = f.dataType.simpleString()
        plain = not any(x in kind for x in ("map<", "variant", "geo"))
        columns.append(column(f.name) if plain else F.to_json(F.struct(column(f.name).alias("v")), {"ignoreNullFields": "false"}))
    return [F.xxhash64(*columns).alias(ROW[0]), F.xxhash64(F.lit(5), *reversed(columns)).alias(ROW[1])]


def pick(keyed: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows with ``ROW`` joined to ``chosen`` by that key, rows that are wholly alike once.

    A merge join at any size: texts move once, and a choice that happens to be small isn't
    broadcast.
    """
    return keyed.dropDuplicates(ROW).join(chosen.hint("merge"), ROW)


def hashed_share(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df``, those whose hash of ``key`` is lowest; all, if it has fewer.

    A threshold on the hash takes the place of a sort, so no task gathers the candidates of
    all others. Rows of equal keys come together.
    """
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.xxhash64(key, F.lit(11)) < int(-(2**63) + 2**64 * rows / total))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(a, b)`` links of long node ids to ``(node, root)``, root the smallest id of the component.

    Alternates large-star and small-star steps (Kiveris et al., 2014) on edge tables;
    every round ends in a scratch table, nothing of the graph reaches the driver but a
    count and a checksum. Only linked nodes are returned.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(now)
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = saved(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v")))
        new = saved(small.where("u <> v").distinct())
        for x in (now, low, large, least):
            drop_saved(x)
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return row["n"], row["x"]
