"""The fold that all sources share: numbering, as-of matching, usage, header rules.

A source classifies its lines into messages, calls, results and usage rows keyed by
``(file_path, ord)``; everything order-sensitive happens here, in windows and aggregates
over ``file_path``, so one exchange serves the whole fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import MESSAGE_STATS, RELATED, SESSION_STATS, Index


def last_of(c: Column, order: str = "ord") -> Column:
    """Last non-null value in line order."""
    return F.max_by(c, F.when(c.isNotNull(), F.col(order)))


def first_of(c: Column, order: str = "ord") -> Column:
    return F.min_by(c, F.when(c.isNotNull(), F.col(order)))


def match_results(calls: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As-of backward join of results to the latest earlier call of the same id.

    ``calls`` has (file_path, ord, ix, id), ``results`` (file_path, ord, ix, id, output,
    status) and maybe more. Returns the outcome of each matched call (the last output, the
    last status that isn't unknown), and the results that no call precedes.
    """
    use = F.struct(F.col("ord").alias("use_ord"), F.col("ix").alias("use_ix"))
    both = calls.where("id is not null").select("file_path", "id", "ord", "ix", use.alias("use"), F.lit(0).alias("kind")).unionByName(
        results.select("file_path", "id", "ord", "ix", F.lit(1).alias("kind"), F.struct(*(c for c in results.columns if c not in ("file_path", "id", "ord", "ix"))).alias("r")),
        allowMissingColumns=True,
    )
    upto = Window.partitionBy("file_path", "id").orderBy("ord", "kind", "ix").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("at", F.when(F.col("id").isNotNull(), F.last("use", ignorenulls=True).over(upto))).where("kind = 1")
    order = F.struct("ord", "ix")
    known = F.when(F.col("r.status") != "unknown", F.col("r.status"))
    matched = seen.where("at is not null").groupBy("file_path", F.col("at.use_ord").alias("ord"), F.col("at.use_ix").alias("ix")).agg(
        F.max_by("r.output", order).alias("output"), F.max_by(known, F.when(known.isNotNull(), order)).alias("status")
    )
    return matched, seen.where("at is null").select("file_path", "id", "ord", "ix", "r.*")


def attach_usage(messages: DataFrame, usage: DataFrame) -> DataFrame:
    """First usage row after each assistant message, before the next one: (file_path, ord, stats).

    ``messages`` gives (file_path, ord) of assistant messages, ``usage`` (file_path, ord, stats).
    """
    both = messages.select("file_path", "ord", F.col("ord").alias("own"), F.lit(None).cast(MESSAGE_STATS).alias("stats")).unionByName(
        usage.select("file_path", "ord", F.lit(None).cast("int").alias("own"), F.col("stats").cast(MESSAGE_STATS).alias("stats"))
    )
    upto = Window.partitionBy("file_path").orderBy("ord", F.col("own").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("at", F.last("own", ignorenulls=True).over(upto)).where("own is null and at is not null")
    return seen.groupBy("file_path", F.col("at").alias("ord")).agg(F.min_by("stats", "ord").alias("stats"))


def last_title(events: DataFrame) -> DataFrame:
    """``events`` (file_path, key, ord, title) with ``known``: own title, else the latest earlier one of the key."""
    before = Window.partitionBy("file_path", "key").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("known", F.coalesce("title", F.last("remembered", ignorenulls=True).over(before)))


def number(messages: DataFrame) -> DataFrame:
    return messages.withColumn("msg_index", F.row_number().over(Window.partitionBy("file_path").orderBy("ord", "sub_ord")))


def assemble(files: DataFrame, header: DataFrame, messages: DataFrame, calls: DataFrame) -> Index:
    """An index of numbered messages and calls; every file has a session, also an empty one.

    ``header`` has (file_path, session_id, project, cwd, started_at, ended_at, model, stats)
    for files that have lines; ``files`` has fallbacks ``stem`` and ``folder_project``.
    """
    numbered = number(messages)
    counts = numbered.groupBy("file_path").agg(F.count("*").alias("message_count"))
    sessions = files.join(header, "file_path", "left").join(counts, "file_path", "left")
    sessions = sessions.select(
        "agent",
        "agent_ord",
        "file_path",
        "file_ord",
        F.coalesce("session_id", "stem").alias("session_id"),
        F.coalesce("project", "folder_project").alias("project"),
        "cwd",
        F.coalesce("started_at", F.lit("")).alias("started_at"),
        "ended_at",
        F.try_to_timestamp(F.nullif("started_at", F.lit(""))).alias("started_ts"),
        F.try_to_timestamp(F.nullif("ended_at", F.lit(""))).alias("ended_ts"),
        "model",
        F.coalesce("message_count", F.lit(0)).alias("message_count"),
        F.col("stats").cast(SESSION_STATS).alias("stats"),
    )
    named = numbered.join(sessions.select("file_path", "agent", "session_id"), "file_path").withColumn("ts", F.try_to_timestamp(F.nullif("timestamp", F.lit(""))))
    place = numbered.select("file_path", "ord", "sub_ord", "msg_index")
    return Index.from_frames(sessions, named, calls.join(place, ["file_path", "ord", "sub_ord"]))


def message(role: Column | str, text: Column, timestamp: Column, subtype: Column | str | None = None, related: Column | None = None, stats: Column | None = None, sub_ord: Column | int = 0) -> list[Column]:
    """The columns of a message row beside its key."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [
        as_col(sub_ord).cast("int").alias("sub_ord"),
        as_col(role).cast("string").alias("role"),
        as_col(subtype).cast("string").alias("subtype"),
        text.alias("text"),
        timestamp.alias("timestamp"),
        (F.lit(None) if related is None else related).cast(RELATED).alias("related"),
        (F.lit(None) if stats is None else stats).cast(MESSAGE_STATS).alias("stats"),
    ]
