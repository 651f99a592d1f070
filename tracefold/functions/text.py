"""Column expressions over text, as the queries and renderers use them."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as the transcript tools understand it: ASCII, and the Unicode spaces.
SPACE = r"[\t-\r    -     　﻿]"
SUFFIX = " …[truncated]"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), f"(?<!{SPACE}){SPACE}+$", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(~c.rlike(f"(?s)[^{SPACE[1:-1]}]"), F.lit(True))


def cut(c: Column, most: int = 4000, suffix: str = SUFFIX) -> Column:
    """The text, or its first ``most`` characters and a suffix."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(suffix))).otherwise(c)


def ellipsis(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def snippet(c: Column, query: str, most: int = 500) -> Column:
    """``most`` characters around the first match, with an ellipsis on cut sides."""
    at = F.locate(query.lower(), F.lower(c)) - 1
    start = F.greatest(F.lit(0), at - (most - 1) // 2)
    end = F.least(F.length(c), start + most)
    part = F.concat(F.when(start > 0, "…").otherwise(""), c.substr(start + 1, end - start), F.when(end < F.length(c), "…").otherwise(""))
    return F.when(F.length(c) <= most, c).when(at < 0, ellipsis(c, most)).otherwise(part)


def has(c: Column, query: str) -> Column:
    """Case-insensitive substring test; null has nothing."""
    return F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))


def first_line(c: Column) -> Column:
    head = strip(F.split(c, "\r?\n", 2)[0])
    return F.when(head != "", head).otherwise(strip(c))


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def indent(c: Column, prefix: str) -> Column:
    return F.regexp_replace(c, "(?m)^", prefix)


def role_label(role: Column, subtype: Column) -> Column:
    plain = F.create_map(*[F.lit(x) for r in ("system", "tool", "user", "assistant") for x in (r, r.capitalize())])
    return F.when(role == "summary", summary_label(F.coalesce(subtype, F.lit("summary")))).otherwise(F.coalesce(plain[role], role))


#: Headings of summary kinds.
SUMMARY_LABELS = {"memory": "Session Memory", "compaction": "Context Summary", "wrapped_session": "Original Session", "sub_agent": "Sub-Agent Session", "recap": "Session Recap"}


def summary_label(subtype: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SUMMARY_LABELS.items() for x in pair])
    return F.coalesce(known[subtype], F.concat(F.lit("Summary ("), subtype, F.lit(")")))


def role_class(role: Column) -> Column:
    return F.lower(F.regexp_replace(role, "[^A-Za-z0-9_-]", "-"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")


def decode_folder(name: Column) -> Column:
    """A folder name that encodes a path with dashes; lossy by nature."""
    return F.translate(name, "-", "/")


def slug_key(text: str | None) -> str:
    plain = unicodedata.normalize("NFKD", (text or "").lower())
    kept = "".join(" " if not (c.isascii() and c.isalnum()) else c for c in plain if not "̀" <= c <= "ͯ")
    return "-".join(kept.split()) or "session"


@F.pandas_udf(StringType())
def slugify(texts: pd.Series) -> pd.Series:
    """Lower case, accents folded (NFKD), other runs to one dash; Spark has no normaliser."""
    return texts.map(slug_key)


@F.pandas_udf(StringType())
def json_pretty(texts: pd.Series) -> pd.Series:
    """JSON text indented by 2; what isn't JSON stays as a JSON string."""

    def one(t: str | None) -> str | None:
        if t is None:
            return "null"
        try:
            return json.dumps(json.loads(t), indent=2, ensure_ascii=False)
        except ValueError:
            return json.dumps(t, ensure_ascii=False)

    return texts.map(one)


def json_quote(c: Column) -> Column:
    """A JSON string literal: the value of a one-field object."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def fence_normalised(c: Column) -> Column:
    """Blank lines around code fences, decided by the parity of the fences before a line."""
    lines = F.split(c, "\n", -1)
    fence = lambda x: x.rlike("^\\s*(```+|~~~+)")
    blank = lambda x: x.rlike("^\\s*$")

    def step(acc: Column, i: Column) -> Column:
        line = lines[i]
        opens, closes = fence(line) & ~acc["inside"], fence(line) & acc["inside"]
        before = F.when(opens & (F.size(acc["out"]) > 0) & ~F.coalesce(blank(F.element_at(acc["out"], -1)), F.lit(True)), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        after = F.when(closes & F.coalesce(~blank(F.get(lines, i + 1)), F.lit(False)), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.struct((acc["inside"] != fence(line)).alias("inside"), F.concat(acc["out"], before, F.array(line), after).alias("out"))

    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("out"))
    joined = F.aggregate(F.sequence(F.lit(0), F.size(lines) - 1), start, step, lambda acc: F.array_join(acc["out"], "\n"))
    return F.when(c.rlike("(?m)^\\s*(```|~~~)"), joined).otherwise(c)
