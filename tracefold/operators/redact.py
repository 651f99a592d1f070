"""Redaction as an ordered list of rules over text, with counts and findings.

Rules run one after another on the rewritten text, so a rule counts what is left for it.
Text columns of any number of rows are redacted by column expressions (``columns``); a
nested document keeps its shape and gets findings with their paths (``documents``), for
which a recursive walk in an Arrow UDF is needed. Both read the same rules.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import checked

MODES = ["none", "minimal", "cautious", "strict"]
KINDS = ["env_assignment", "secret_like", "email", "url_query", "home_path", "known_auth_file", "long_output_collapsed"]
#: Longest output kept whole in each mode (fixed values).
MAX_OUTPUT = {"strict": 1000, "cautious": 2000, "minimal": None}


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # valid for Java and Python alike
    replacement: str  # with $1, $2
    modes: tuple[str, ...] = ("minimal", "cautious", "strict")
    needs: tuple[str, ...] = ()  # every match holds one of these


_L, _R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_VALUE = "=(?:\"[^\"]*\"|'[^']*'|[^\\s\"'`]+)"
_MOST, _STRICT = ("cautious", "strict"), ("strict",)
_SECRET = "[REDACTED_SECRET]"
_URL = "[^\\s\"'<>)}\\]"
#: What is redacted, and by what (fixed values: patterns and marks).
RULES = [
    Rule("env_assignment", f"{_L}([A-Z][A-Z0-9_]{{2,}}){_VALUE}", "$1=[REDACTED_ENV]", _STRICT, ("=",)),
    Rule("env_assignment", f"{_L}([A-Z][A-Z0-9_]*(?:TOKEN|SECRET|KEY|PASSWORD|PASS|AUTH|CREDENTIAL)[A-Z0-9_]*){_VALUE}", "$1=[REDACTED_ENV]", ("minimal", "cautious"), ("=",)),
    Rule("secret_like", f"{_L}((?:[Aa]pple [Dd]eveloper )?[Tt]eam(?:\\s+ID)?(?:\\s+is)?\\s+`?)[A-Z0-9]{{10}}(`?)", f"$1{_SECRET}$2", _MOST, ("eam",)),
    Rule("secret_like", f"{_L}(?:DEVELOPMENT_TEAM(?:\\s*=)?|[Aa]pplication-identifier:\\s*)`?[A-Z0-9]{{10}}(`?)", f"{_SECRET}$1", _MOST, ("DEVELOPMENT_TEAM", "pplication-identifier:")),
    Rule("secret_like", f"{_L}([A-Z]{{1,9}}_DEV_TEAM=`?)[A-Z0-9]{{10}}(`?)", f"$1{_SECRET}$2", _MOST, ("_DEV_TEAM=",)),
    Rule("secret_like", f"{_L}[0-9A-Fa-f]{{8}}-[0-9A-Fa-f]{{16}}{_R}", _SECRET, _MOST),
    Rule("secret_like", "(?<![A-Z0-9])(?=[A-Z0-9]{10}(?![A-Z0-9]))(?=[A-Z0-9]*[A-Z])(?=[A-Z0-9]*[0-9])[A-Z0-9]{10}", _SECRET, _MOST),
    Rule("secret_like", f"{_L}sk-[A-Za-z0-9_-]{{8,}}(?<![-])", _SECRET, ("minimal", "cautious", "strict"), ("sk-",)),
    Rule("secret_like", f"{_L}ghp_[A-Za-z0-9_]{{8,}}", _SECRET, ("minimal", "cautious", "strict"), ("ghp_",)),
    Rule("secret_like", f"{_L}glpat-[A-Za-z0-9_-]{{8,}}(?<![-])", _SECRET, ("minimal", "cautious", "strict"), ("glpat-",)),
    Rule("secret_like", f"{_L}pat_[A-Za-z0-9._-]{{8,}}(?<![.-])", _SECRET, ("minimal", "cautious", "strict"), ("pat_",)),
    Rule("secret_like", f"{_L}eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+(?<![-])", _SECRET, ("minimal", "cautious", "strict"), ("eyJ",)),
    Rule("secret_like", f"{_L}[A-Fa-f0-9]{{40,}}{_R}", _SECRET, _STRICT),
    Rule("secret_like", f"{_L}[A-Za-z0-9+/]{{48,}}={{0,2}}(?:(?<=[A-Za-z0-9_]){_R}|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))", _SECRET, _STRICT),
    Rule("email", f"(?<![A-Za-z0-9._%+/-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}{_R}", "[REDACTED_EMAIL]", _MOST, ("@",)),
    Rule("url_query", f"(https?://){_URL}/?#@]+@({_URL}/?#@]+)(/{_URL}?#]*)(?:[?#]{_URL}]*)?", "$1$2$3", _MOST, ("://",)),
    Rule("url_query", f"(https?://){_URL}/?#@]+@({_URL}/?#@]+)(?:[?#]{_URL}]*)?", "$1$2/", _MOST, ("://",)),
    Rule("url_query", f"(https?://{_URL}/?#@]+)(/{_URL}?#]*)[?#]{_URL}]+", "$1$2", _MOST, ("://",)),
    Rule("url_query", f"(https?://{_URL}/?#@]+)[?#]{_URL}]+", "$1/", _MOST, ("://",)),
    Rule("home_path", "/Users/[A-Za-z0-9._-]+(?=/|$)", "~", _MOST, ("/Users/",)),
    Rule("home_path", "/home/[A-Za-z0-9._-]+(?=/|$)", "~", _MOST, ("/home/",)),
    Rule("known_auth_file", "(?:^|([ ])|[\\s\"'(])[^\\s\"'()]*?(?:\\.env(?:\\.[A-Za-z0-9_-]+)?|auth\\.json|\\.npmrc|\\.pem|\\.p8|\\.ssh/[^\\s\"'()]+)", "$1[REDACTED_AUTH_PATH]", _MOST, (".env", "auth.json", ".npmrc", ".pem", ".p8", ".ssh/")),
]


def rules_for(mode: str) -> list[Rule]:
    checked(mode, MODES, "redaction mode")
    return [r for r in RULES if mode in r.modes]


def limit_for(mode: str, max_output: int | None = None) -> int | None:
    return max_output if max_output is not None else MAX_OUTPUT.get(mode)


def _once(name: str, rule: Rule, of: Callable[[Column, Rule], Column]) -> Column:
    """``of`` a column that is named once: the optimizer may put a long chain of rules in its place."""
    return F.transform(F.array(F.col(name)), lambda text: of(text, rule))[0]


def _may(text: Column, rule: Rule) -> Column:
    """Whether a rule can match; a search for fixed strings costs far less than its pattern."""
    return reduce(Column.__or__, (F.contains(text, F.lit(x)) for x in rule.needs)) if rule.needs else text.isNotNull()


def columns(df: DataFrame, names: list[str], mode: str, outputs: tuple[str, ...] = (), max_output: int | None = None, counts: str = "redactions") -> DataFrame:
    """``df`` with its text columns redacted and a map of counts by kind, zeros included.

    ``outputs`` names the columns that are tool outputs, which are collapsed first.
    """
    rules, most = rules_for(mode), limit_for(mode, max_output)
    found: dict[str, list[str]] = {k: [] for k in KINDS}
    extra = []
    for name in names:
        if name in outputs and most is not None and mode != "none":
            n = f"__n_{name}_cut"
            long = F.coalesce(F.length(name) > most, F.lit(False))
            df = df.withColumns({n: long.cast("bigint"), name: F.when(long, F.concat(F.substring(name, 1, most), F.lit("\n[... output collapsed; "), (F.length(name) - most).cast("string"), F.lit(" chars omitted ...]"))).otherwise(F.col(name))})
            found["long_output_collapsed"].append(n)
            extra.append(n)
        for i, r in enumerate(rules):
            n = f"__n_{name}_{i}"
            count = _once(name, r, lambda t, r: F.when(_may(t, r), F.regexp_count(t, F.lit(r.pattern))))
            put = _once(name, r, lambda t, r: F.when(_may(t, r), F.regexp_replace(t, r.pattern, r.replacement)).otherwise(t))
            df = df.withColumns({n: F.coalesce(count, F.lit(0)).cast("bigint"), name: put})
            found[r.kind].append(n)
            extra.append(n)
    total = F.create_map(*[x for k, ns in found.items() for x in (F.lit(k), F.expr(" + ".join(ns)) if ns else F.lit(0).cast("bigint"))])
    return df.withColumn(counts, total).drop(*extra)


def totals(df: DataFrame, counts: str = "redactions") -> DataFrame:
    """``(kind, n)`` over all rows of ``columns``, zeros included; one aggregate, spread into rows after it."""
    sums = df.agg(*(F.coalesce(F.sum(F.col(counts)[k]), F.lit(0)).cast("bigint").alias(k) for k in KINDS))
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in KINDS))
    return sums.select(F.explode(rows).alias("x")).select("x.*")


class Redactor:
    """The same rules over one nested document, with a finding for every replacement."""

    def __init__(self, mode: str, max_output: int | None = None):
        self.most = limit_for(mode, max_output)
        self.rules = [(r.kind, re.compile(r.pattern), re.sub(r"\$(\d)", r"\\g<\1>", r.replacement)) for r in rules_for(mode) if r.kind != "url_query"]
        self.urls = mode in _MOST
        self.active = mode != "none"
        self.findings: list[tuple[str, str, str]] = []

    def walk(self, value, path: str = "$"):
        if isinstance(value, str):
            return self.text(value, path) if self.active else value
        if isinstance(value, list):
            return [self.walk(x, f"{path}[{i}]") for i, x in enumerate(value)]
        if isinstance(value, dict):
            return {k: self.walk(x, f"{path}.{k}") for k, x in value.items()}
        return value

    def text(self, value: str, path: str) -> str:
        if self.most is not None and path.endswith(".output") and len(value) > self.most:
            value = f"{value[: self.most]}\n[... output collapsed; {len(value) - self.most} chars omitted ...]"
            self.findings.append(("long_output_collapsed", path, "[OUTPUT_COLLAPSED]"))
        done = not self.urls
        for kind, pattern, replacement in self.rules:
            if not done and kind in ("home_path", "known_auth_file"):
                value, done = re.sub(rf"https?://{_URL}]+", lambda m: self._url(m[0], path), value), True

            def put(m: re.Match, kind=kind, replacement=replacement) -> str:
                new = m.expand(replacement)
                if new != m[0]:
                    self.findings.append((kind, path, new))
                return new

            value = pattern.sub(put, value)
        return value

    def _url(self, url: str, path: str) -> str:
        try:
            parts = urlsplit(url)
            host, port = parts.hostname or "", parts.port
        except ValueError:
            return url
        if not host or not (parts.username or parts.password or parts.query or parts.fragment):
            return url
        usual = {"http": 80, "https": 443}[parts.scheme]
        self.findings.append(("url_query", path, "[REDACTED_URL_QUERY]"))
        return f"{parts.scheme}://{host}{f':{port}' if port not in (None, usual) else ''}{parts.path or '/'}"


REPORT = "json string, counts map<string,bigint>, findings array<struct<kind:string,path:string,replacement:string>>"


def documents(df: DataFrame, name: str, mode: str, max_output: int | None = None, into: str = "redacted") -> DataFrame:
    """``df`` with a struct of the redacted JSON text of column ``name``, counts by kind, and findings.

    Keys are not redacted; a value that was redacted is never reported.
    """
    rules_for(mode)

    @F.pandas_udf(REPORT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch:
                r = Redactor(mode, max_output)
                out = None if t is None else json.dumps(r.walk(json.loads(t)), ensure_ascii=False)
                counts = {k: sum(f[0] == k for f in r.findings) for k in KINDS}
                rows.append((out, counts, [dict(zip(("kind", "path", "replacement"), f)) for f in r.findings]))
            yield pd.DataFrame(rows, columns=["json", "counts", "findings"])

    return df.withColumn(into, run(F.col(name)))
