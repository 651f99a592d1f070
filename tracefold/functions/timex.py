"""Time arguments and durations."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours of the relative units; a month counts as 30 days (fixed values).
UNIT_HOURS = {"h": 1, "d": 24, "w": 168, "m": 720}


def parse_time(arg: str, now: datetime | None = None, edge: str = "start") -> datetime | None:
    """``7d``, ``24h``, ``2w``, ``3m``, a date or a date and time; None if it is none of these.

    A bare date is the first instant of that UTC day, or its last millisecond for ``edge='end'``.
    """
    now = now or datetime.now(timezone.utc)
    if m := re.fullmatch(r"(\d+(?:\.\d+)?)\s*([hdwm])", arg):
        return now - timedelta(hours=float(m[1]) * UNIT_HOURS[m[2]])
    try:
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", arg):
            day = datetime.strptime(arg, "%Y-%m-%d").replace(tzinfo=timezone.utc)
            return day + timedelta(days=1, milliseconds=-1) if edge == "end" else day
        t = datetime.fromisoformat(arg)
    except ValueError:
        return None
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


def instant(t: datetime) -> Column:
    return F.timestamp_micros(F.lit(round(t.timestamp() * 1_000_000)))


def within(ts: Column, since: datetime | None, until: datetime | None) -> Column:
    """Inclusive window; without bounds everything passes, with a bound a null time doesn't."""
    test = F.lit(True)
    if since:
        test = test & (ts >= instant(since))
    if until:
        test = test & (ts <= instant(until))
    return F.coalesce(test, F.lit(False))


def parsed(c: Column) -> Column:
    return F.try_to_timestamp(c)


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_millis(end) - F.unix_millis(start)) / 60000.0


def duration_text(ms: Column) -> Column:
    mins = F.floor(ms / 60000.0 + 0.5)
    hours = F.floor(mins / 60)
    return (
        F.when(mins < 60, F.concat(mins.cast("string"), F.lit(" min")))
        .when(hours < 24, F.concat_ws("", hours.cast("string"), F.lit("h "), (mins % 60).cast("string"), F.lit("m")))
        .otherwise(F.concat_ws("", F.floor(hours / 24).cast("string"), F.lit("d "), (hours % 24).cast("string"), F.lit("h")))
    )


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
