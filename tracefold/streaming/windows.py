"""Watermarked activity windows over a stream (or a batch) of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity_windows(messages: DataFrame, gap: str = "2 hours", delay: str = "1 day", time: str = "ts", key: str = "file_path") -> DataFrame:
    """Messages of a session that follow one another within ``gap``; later than ``delay`` is dropped on streams."""
    windowed = messages.withWatermark(time, delay) if messages.isStreaming else messages
    grouped = windowed.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("messages"))
    return grouped.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "messages")


def tumbling_counts(messages: DataFrame, width: str = "1 hour", delay: str = "1 day", time: str = "ts", key: str = "agent") -> DataFrame:
    windowed = messages.withWatermark(time, delay) if messages.isStreaming else messages
    grouped = windowed.groupBy(key, F.window(time, width).alias("w")).agg(F.count("*").alias("messages"))
    return grouped.select(key, F.col("w.start").alias("started"), "messages")
