"""Session filters, sorts and point lookups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has
from ..functions.timex import parse_time, within
from ..model import TIERS, VALID_AGENTS


class NotFound(LookupError):
    """No session has the id prefix."""


class Ambiguous(LookupError):
    """Several sessions have the id prefix; ``matches`` lists up to ten."""

    def __init__(self, prefix: str, matches: list[tuple[str, str]]):
        super().__init__(f"{prefix!r} is ambiguous: " + ", ".join(f"{a} {s}" for a, s in matches))
        self.matches = matches


def checked(value: str | None, allowed: list[str], what: str) -> str | None:
    if value is not None and value not in allowed:
        raise ValueError(f"invalid {what} {value!r}; one of {', '.join(allowed)}")
    return value


def check_agent(agent: str | None) -> str | None:
    return checked(agent, VALID_AGENTS, "agent")


def time_bound(arg: str | datetime | None, edge: str, now: datetime | None = None) -> datetime | None:
    if arg is None or isinstance(arg, datetime):
        return arg
    t = parse_time(arg, now, edge)
    if t is None:
        raise ValueError(f"invalid time {arg!r}")
    return t


def by_agent(sessions: DataFrame, agent: str | None) -> DataFrame:
    return sessions if check_agent(agent) is None else sessions.where(F.col("agent") == agent)


def by_project(sessions: DataFrame, project: str | None) -> DataFrame:
    return sessions if not project else sessions.where(has(F.col("project"), project) | has(F.col("cwd"), project))


def by_time(sessions: DataFrame, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    return sessions if not since and not until else sessions.where(within(F.col("started_ts"), since, until))


def by_importance(scored: DataFrame, tier: str | None) -> DataFrame:
    return scored if checked(tier, TIERS, "tier") is None else scored.where(F.col("tier").isin(TIERS[TIERS.index(tier) :]))




def order_by(scored: DataFrame, sort: str) -> DataFrame:
    """Most recent or most important first; scan order breaks ties, an unknown start comes last."""
    key = {"recent": "started_at", "importance": "score"}[checked(sort, ["recent", "importance"], "sort")]
    return scored.orderBy(F.desc(key), "agent_ord", "file_ord")


def matching(sessions: DataFrame, prefix: str | Column, agent: str | None = None) -> DataFrame:
    """Sessions whose id starts with ``prefix``, a text or a column of theirs."""
    return by_agent(sessions, agent).where(F.startswith("session_id", F.lit(prefix)))


def resolve(sessions: DataFrame, prefix: str, agent: str | None = None) -> str:
    """The file path of the one session whose id starts with ``prefix``."""
    hits = matching(sessions, prefix, agent).select("agent", "session_id", "file_path").limit(11).collect()
    if not hits:
        raise NotFound(f"no session starts with {prefix!r}")
    if len(hits) > 1:
        raise Ambiguous(prefix, [(h["agent"], h["session_id"]) for h in hits[:10]])
    return hits[0]["file_path"]
