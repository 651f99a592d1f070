"""Source D: one JSON document of lifetime totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx as J
from .raw import configure, expand_home

DEFAULT_PATH = "~/.claude/stats-cache.json"
_MODEL = ("inputTokens", "outputTokens", "cacheReadInputTokens", "cacheCreationInputTokens", "webSearchRequests")


def _records(path: str) -> str:
    return f"filter({J.array('v', path)}, x -> {J.is_object('x')})"


def _map(value: str, path: str) -> str:
    return f"coalesce(case when {J.is_object(value, path)} then try_variant_get({value}, '{path}', 'map<string,variant>') end, cast(map() as map<string,variant>))"


def _numbers(value: str, path: str) -> str:
    return f"transform_values(map_filter({_map(value, path)}, (k, x) -> {J.is_number('x')}), (k, x) -> {J.count('x')})"


def read(spark: SparkSession, path: str = DEFAULT_PATH) -> DataFrame:
    """One row, or none if the document is missing or no JSON object; every field is coerced."""
    configure(spark)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(expand_home(path))
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        text = spark.read.text(expand_home(path), wholetext=True)
    else:
        text = spark.createDataFrame([], "value string")
    return coerce(text)


def coerce(texts: DataFrame) -> DataFrame:
    doc = texts.select(F.try_parse_json("value").alias("v")).where(F.expr(J.is_object("v")))
    text = lambda p: F.expr(f"coalesce({J.string('v', p)}, '')")
    day = ", ".join(f"'{k}', {J.count('x', '$.' + k)}" for k in ("messageCount", "sessionCount", "toolCallCount"))
    model = ", ".join(f"'{k}', {J.count('x', '$.' + k)}" for k in _MODEL)
    return doc.select(
        F.expr(J.count("v", "$.version")).alias("version"), text("$.lastComputedDate").alias("last_computed_date"), text("$.firstSessionDate").alias("first_session_date"),
        F.expr(J.count("v", "$.totalSessions")).alias("total_sessions"), F.expr(J.count("v", "$.totalMessages")).alias("total_messages"),
        F.struct(text("$.longestSession.sessionId").alias("session_id"), F.expr(J.count("v", "$.longestSession.duration")).alias("duration"), F.expr(J.count("v", "$.longestSession.messageCount")).alias("message_count"), text("$.longestSession.timestamp").alias("timestamp")).alias("longest_session"),
        F.expr(f"transform_values(map_filter({_map('v', '$.modelUsage')}, (k, x) -> {J.is_object('x')}), (k, x) -> named_struct({model}))").alias("model_usage"),
        F.expr(f"transform({_records('$.dailyActivity')}, x -> named_struct('date', coalesce({J.string('x', '$.date')}, ''), {day}))").alias("daily_activity"),
        F.expr(f"transform({_records('$.dailyModelTokens')}, x -> named_struct('date', coalesce({J.string('x', '$.date')}, ''), 'tokensByModel', {_numbers('x', '$.tokensByModel')}))").alias("daily_model_tokens"),
        F.expr(_numbers("v", "$.hourCounts")).alias("hour_counts"),
    )


def models_ranked(cache: DataFrame) -> DataFrame:
    """Models by output and cache-read tokens, most first."""
    rows = cache.select(F.explode("model_usage").alias("model", "u")).select("model", "u.*")
    return rows.orderBy(F.desc(F.col("outputTokens") + F.col("cacheReadInputTokens")), "model")


def busiest_hours(cache: DataFrame, k: int = 5) -> DataFrame:
    return cache.select(F.explode("hour_counts").alias("hour", "n")).orderBy(F.desc("n"), F.col("hour").cast("int")).limit(k)
