"""The registry of sources, and the scan over all of them."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SOURCE_A, SOURCE_B, SOURCE_C, VALID_AGENTS, Index
from . import source_a, source_b, source_c
from .raw import configure, read_texts


class Source(Protocol):
    """What a source is: a module or an object with these."""

    AGENT: str
    DEFAULT_ROOT: str | None

    def discover(self, spark: SparkSession, root: str) -> list[str]:
        """Sorted log paths below a root; none if it is missing."""

    def parse(self, spark: SparkSession, paths: list[str], agent_ord: int) -> Index:
        """An index with a session for every path, whatever it holds."""


#: Sources in scan order.
REGISTRY: dict[str, Source] = {SOURCE_A: source_a, SOURCE_B: source_b, SOURCE_C: source_c}


def register(source: Source) -> None:
    """Add a source to the end of the scan order, or replace the one of the same label."""
    REGISTRY[source.AGENT] = source
    if source.AGENT not in VALID_AGENTS:
        VALID_AGENTS.append(source.AGENT)


def default_roots() -> dict[str, str]:
    return {name: m.DEFAULT_ROOT for name, m in REGISTRY.items() if m.DEFAULT_ROOT}


def union(parts: list[Index]) -> Index:
    """One index of the sessions of several."""
    every = lambda part: reduce(DataFrame.unionByName, (getattr(x, part) for x in parts))
    return Index(every("sessions"), every("messages"), every("tool_calls"))


def scan(spark: SparkSession, roots: dict[str, str] | None = None, containing: str | None = None) -> Index:
    """All sessions below the roots, a root a source; missing roots have none.

    ``containing`` reads only files whose raw text has that string, whatever its case. It
    skips work before parsing, and may miss matches that only parsing makes.
    """
    configure(spark)
    found = []
    for i, (agent, source) in enumerate(REGISTRY.items()):
        root = (default_roots() if roots is None else roots).get(agent)
        if not root:
            continue
        paths = source.discover(spark, root)
        if containing:
            hit = read_texts(spark, paths).where(F.contains(F.lower("value"), F.lit(containing.lower()))).select("file_path")
            kept = {r["file_path"] for r in hit.collect()}
            paths = [p for p in paths if p in kept]
        if paths:
            found.append(source.parse(spark, paths, i))
    return union(found) if found else Index.empty(spark)
