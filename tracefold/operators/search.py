"""Full-text search over messages and tool calls."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has, snippet
from ..functions.timex import within
from ..model import SOURCE_B, SOURCE_C, Index
from .filters import by_agent, by_project

SNIPPET = 500


def wrapped_sessions(index: Index) -> DataFrame:
    """Ids of sessions that another session ran underneath itself."""
    return index.related().where((F.col("from_agent") == SOURCE_C) & (F.col("kind") == "wrapped_session")).select(F.col("session_id").alias("wrapped_id")).distinct()


def condensed_wrappers(index: Index) -> DataFrame:
    """Ids of wrapper sessions whose original is in the index too."""
    originals = index.sessions.where(F.col("agent") == SOURCE_B).select("session_id")
    edges = index.related().where((F.col("from_agent") == SOURCE_C) & (F.col("kind") == "wrapped_session"))
    return edges.join(originals, "session_id", "left_semi").select(F.col("from_session").alias("session_id")).distinct()


def search(index: Index, query: str, agent: str | None = None, project: str | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Hits in scan order: a message's text, then its calls.

    Wrapper sessions are left out where the original is in the whole index, whatever the filters.
    """
    if not query:
        raise ValueError("nothing to search for")
    sessions = by_project(by_agent(index.sessions, agent), project).join(condensed_wrappers(index), "session_id", "left_anti")
    place = sessions.select("file_path", "agent_ord", "file_ord", "agent", "session_id")
    messages = index.messages.drop("agent", "session_id")
    if since or until:
        messages = messages.where(within(F.col("ts"), since, until))
    shown = ["agent", "session_id", F.col("msg_index").alias("message_index"), "role", "text", "timestamp", "tool_call", "agent_ord", "file_ord", "hit"]
    texts = messages.where(has(F.col("text"), query)).withColumn("tool_call", F.lit(None).cast("string")).withColumn("hit", F.lit(-1))
    calls = index.tool_calls.withColumn("in_output", has(F.col("output"), query)).where(F.col("in_output") | has(F.col("input_json"), query))
    found = F.when(F.col("in_output"), F.col("output")).otherwise(F.col("input_json"))
    calls = calls.select("file_path", "msg_index", F.col("call_index").alias("hit"), F.col("name").alias("tool_call"), snippet(found, query, SNIPPET).alias("text"))
    used = messages.drop("text").join(calls, ["file_path", "msg_index"])
    hits = texts.select("file_path", "msg_index", "role", "text", "timestamp", "tool_call", "hit").unionByName(used.select("file_path", "msg_index", "role", "text", "timestamp", "tool_call", "hit"))
    return hits.join(place, "file_path").select(*shown).orderBy("agent_ord", "file_ord", "message_index", "hit")
