"""Distinct references between sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Index


def distinct_related(index: Index) -> DataFrame:
    """References of each session without repeats, in order of first sight; the first title known is kept."""
    edges = index.related().withColumn("at", F.struct("msg_index", "pos"))
    key = ["file_path", "agent", "kind", "session_id", F.coalesce("turn_id", F.lit("")).alias("turn_id"), F.coalesce("path", F.lit("")).alias("path")]
    title = F.min_by("title", F.when(F.col("title").isNotNull(), F.col("at")))
    found = edges.groupBy(*key).agg(F.min("at").alias("at"), title.alias("title"))
    return found.withColumn("turn_id", F.nullif("turn_id", F.lit(""))).withColumn("path", F.nullif("path", F.lit("")))


def related_lists(index: Index) -> DataFrame:
    """One row a session that refers to others: its references as an array."""
    entry = F.struct("at", "agent", "kind", "session_id", "title", "turn_id", "path")
    return distinct_related(index).groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda r: r.dropFields("at")).alias("related_sessions"))
