"""Token statistics: a session's totals and turns, and totals over all sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import SOURCE_B, Index
from .filters import by_agent
from .search import wrapped_sessions

TOKENS = ["total_input_tokens", "total_output_tokens", "cached_input_tokens", "reasoning_tokens"]
WRAPPED, TOTAL = "wrapped", "total"


def shown_total(stats: str = "stats") -> Column:
    """Input, cached, output and reasoning together."""
    return sum((F.col(f"{stats}.{t}") for t in TOKENS[1:]), F.col(f"{stats}.{TOKENS[0]}"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(100.0 * part / whole + 0.5).cast("bigint"))


def session_stats(index: Index) -> DataFrame:
    """One row a session: totals, their sum, context shares, and the turns in order."""
    turn = F.struct("turn", "role", F.struct("input_tokens", "output_tokens", "cached_input_tokens", "reasoning_tokens", "context_size").alias("stats"))
    turns = index.turns().groupBy("file_path").agg(F.array_sort(F.collect_list(turn)).alias("per_turn"))
    out = index.sessions.join(turns, "file_path", "left").withColumn("per_turn", F.coalesce("per_turn", F.array().cast(turns.schema["per_turn"].dataType)))
    window = F.col("stats.context_window")
    return out.select(
        "agent", "session_id", "file_path", "project", "model", "started_at", "ended_at", "message_count", "stats", "per_turn", shown_total().alias("total_tokens"),
        percent(F.col("stats.peak_context_size"), window).alias("peak_percent"), percent(F.col("stats.final_context_size"), window).alias("final_percent"),
    )


def global_stats(index: Index, agent: str | None = None) -> DataFrame:
    """Totals by agent, of all of them, and of wrapped sessions, which no other row counts.

    Which sessions are wrapped is read from the whole index, also under an agent filter.
    """
    wrapped = wrapped_sessions(index).withColumn("is_wrapped", F.lit(True))
    rows = by_agent(index.sessions, agent).join(wrapped, F.col("session_id") == F.col("wrapped_id"), "left")
    held = F.coalesce("is_wrapped", F.lit(False)) & (F.col("agent") == SOURCE_B)
    rows = rows.select("agent", "agent_ord", "stats", held.alias("held"))
    sums = [F.count("*").alias("sessions"), F.count("stats").alias("with_stats"), *(F.coalesce(F.sum(f"stats.{t}"), F.lit(0)).alias(t) for t in TOKENS)]
    counted = rows.where("not held").groupBy(F.col("agent").alias("label"), "agent_ord").agg(*sums)
    total = rows.where("not held").agg(*sums).withColumn("label", F.lit(TOTAL)).withColumn("agent_ord", F.lit(1000))
    under = rows.where("held").agg(*sums).withColumn("label", F.lit(WRAPPED)).withColumn("agent_ord", F.lit(999))
    return counted.unionByName(under).unionByName(total).orderBy("agent_ord").drop("agent_ord")
