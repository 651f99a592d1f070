"""The eight commands as functions of an index; each gives a DataFrame."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SOURCE_A, Index
from ..operators import digest as D
from ..operators import filters, publish, redact, stats
from ..operators import search as S
from ..operators.doctor import doctor as run_doctor
from ..sources import stats_cache

SUMMARY = ["agent", "session_id", "project", "cwd", "started_at", "ended_at", "model", "message_count"]


def list_sessions(index: Index, agent: str | None = None, project: str | None = None, since=None, until=None, min_importance: str | None = None, sort: str = "recent", now: datetime | None = None) -> DataFrame:
    """Summaries; cheap filters run before anything is scored."""
    since, until = filters.time_bound(since, "start", now), filters.time_bound(until, "end", now)
    kept = filters.by_time(filters.by_project(filters.by_agent(index.sessions, agent), project), since, until)
    scored = filters.by_importance(D.substance(Index(kept, index.messages, index.tool_calls)), min_importance)
    return filters.order_by(scored, sort).select(*SUMMARY, F.struct("score", "tier").alias("substance"))


def one(index: Index, prefix: str, agent: str | None = None) -> Index:
    """The part of the index that belongs to one session."""
    path = filters.resolve(index.sessions, prefix, agent)
    return Index(*(frame.where(F.col("file_path") == path) for frame in (index.sessions, index.messages, index.tool_calls)))


def lines(index: Index) -> DataFrame:
    """Messages with their calls, a row a call, and one for a message without."""
    return index.messages.join(index.tool_calls.drop("input"), ["file_path", "msg_index"], "left")


def show(index: Index, prefix: str, agent: str | None = None) -> DataFrame:
    """Messages and their calls in order."""
    return lines(one(index, prefix, agent)).orderBy("msg_index", "call_index")


def search(index: Index, query: str, agent: str | None = None, project: str | None = None, since=None, until=None, now: datetime | None = None) -> DataFrame:
    found = S.search(index, query, agent, project, filters.time_bound(since, "start", now), filters.time_bound(until, "end", now))
    return found.drop("agent_ord", "file_ord", "hit")


def extract(index: Index, prefix: str, agent: str | None = None, full: bool = False) -> DataFrame:
    """The digest of one session as a nested row."""
    return D.digest(one(index, prefix, agent), full).select(publish.digest_struct(full).alias("digest")).select("digest.*")


def redact_check(index: Index, prefix: str, agent: str | None = None, mode: str = "cautious") -> DataFrame:
    found = publish.redacted(publish.bundles(one(index, prefix, agent), mode=mode), mode)
    return found.select("session_id", F.lit(mode).alias("mode"), "redacted.counts", "redacted.findings")


def export_markdown(index: Index, prefix: str, agent: str | None = None, title: str | None = None, mode: str = "cautious", yes: bool = False, generated_at: str | None = None, report_path: str | None = None) -> DataFrame:
    """``(slug, markdown, counts, findings)``; publishing without redaction needs ``yes``."""
    filters.checked(mode, redact.MODES, "redaction mode")
    if mode == "none" and not yes:
        raise ValueError("publishing without redaction has to be confirmed")
    found = publish.redacted(publish.bundles(one(index, prefix, agent), title, generated_at, mode, report_path), mode)
    return publish.markdown(found).select("slug", "markdown", "redacted.counts", "redacted.findings")


def doctor(spark: SparkSession, roots: dict[str, str] | None = None, agent: str | None = None) -> DataFrame:
    return run_doctor(spark, roots, agent)


def session_stats(index: Index, prefix: str, agent: str | None = None) -> DataFrame:
    """One session's totals and turns."""
    return stats.session_stats(one(index, prefix, agent))


def global_stats(index: Index, agent: str | None = None, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Totals by agent, and the lifetime cache where the view is of source A alone.

    Raises LookupError if no session has usage and there is no cache to show.
    """
    totals = stats.global_stats(index, agent)
    lifetime = cache if agent == SOURCE_A else None
    if not totals.where(F.col("label") == stats.TOTAL).first()["with_stats"] and (cache is None or cache.isEmpty()):
        raise LookupError("no usage recorded, and no stats cache found")
    return totals, lifetime


def read_stats_cache(spark: SparkSession, path: str = stats_cache.DEFAULT_PATH) -> DataFrame:
    return stats_cache.read(spark, path)
