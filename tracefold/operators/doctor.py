"""Health of the logs: formats, drift and what doesn't match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions.text import SPACE
from ..model import AGENTS, SOURCE_A, SOURCE_B, SOURCE_C
from ..sources import source_b, source_c
from ..sources.raw import configure, files_frame, lines_of, read_texts
from ..sources.scan import REGISTRY, default_roots
from .filters import check_agent

MARKERS = ["agents_md", "env_context", "user_action"]
EMPTY_HISTOGRAM = "cast(map() as map<string,bigint>)"


def histogram(rows: DataFrame, value: str) -> DataFrame:
    """One row: a map from value to count, empty without rows."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("histogram"))


def marker_of(first_text: Column) -> Column:
    """Which injected opening the first block of the first user item has, or a plain task."""
    trimmed = F.regexp_replace(F.coalesce(first_text, F.lit("")), f"^{SPACE}+", "")
    out = F.lit("plain_task")
    for name, opening in reversed(list(zip(MARKERS, source_b.INJECTED))):
        out = F.when(F.startswith(trimmed, F.lit(opening)), name).otherwise(out)
    return out


def format_of(paths: DataFrame, lines: DataFrame) -> DataFrame:
    """``(file_path, shape)`` of source B's files, by extension or first parsed line."""
    first = lines.groupBy("file_path").agg(F.min_by("v", "ord").alias("first"))
    inside = f"{J.string('first', '$.type')} is not null and ({J.is_object('first', '$.payload')} or {J.is_array('first', '$.payload')})"
    shape = F.when(F.endswith("file_path", F.lit(".json")), "legacy_json").when(F.col("first").isNull(), "unrecognized").when(F.expr(inside), "envelope_jsonl").otherwise("flat_jsonl")
    return paths.join(first, "file_path", "left").select("file_path", shape.alias("shape"))


def diagnose_b(lines: DataFrame, shapes: DataFrame) -> dict[str, DataFrame]:
    """Histograms of shapes, of first user markers, and of unknown envelope and item types."""
    rows = lines.join(shapes.where("shape = 'envelope_jsonl'").select("file_path"), "file_path", "left_semi").withColumn("kind", F.expr(J.string("v", "$.type"))).persist()
    items = rows.where(F.expr(f"kind = 'response_item' and {J.is_object('v', '$.payload')}")).withColumn("item", F.expr(J.string("v", "$.payload.type")))
    spoken = items.where(F.expr(f"{J.string('v', '$.payload.role')} = 'user' and {J.is_array('v', '$.payload.content')}"))
    opening = spoken.groupBy("file_path").agg(F.min_by(F.expr(f"coalesce({J.string('v', '$.payload.content[0].text')}, '')"), "ord").alias("opening"))
    return {
        "format_distribution": histogram(shapes, "shape"),
        "first_user_markers": histogram(opening.select(marker_of(F.col("opening")).alias("marker")), "marker"),
        "unknown_envelope_types": histogram(rows.where(F.col("kind").isNotNull() & ~F.col("kind").isin(*source_b.ENVELOPES)), "kind"),
        "unknown_item_types": histogram(items.where(F.col("item").isNotNull() & ~F.col("item").isin(*source_b.ITEMS)), "item"),
    }


def diagnose_c(lines: DataFrame) -> dict[str, DataFrame]:
    """Histograms of unknown event types and of schema versions."""
    rows = lines.where(F.expr(J.is_object("v"))).withColumn("kind", F.expr(J.string("v", "$.type"))).persist()
    version = F.expr(f"case when {J.is_number('v', '$.schemaVersion')} then to_json({J.at('v', '$.schemaVersion')}) else 'unknown' end")
    return {
        "unknown_event_types": histogram(rows.where(F.col("kind").isNotNull() & ~F.col("kind").isin(*source_c.EVENTS)), "kind"),
        "schema_versions": histogram(rows.where("kind = 'session_init'").select(version.alias("version")), "version"),
    }


def unmatched_uses(tool_calls: DataFrame) -> Column:
    """Calls that no result answered."""
    return F.count_if(F.col("output").isNull() & (F.col("status") == "unknown"))


def doctor(spark: SparkSession, roots: dict[str, str] | None = None, agent: str | None = None) -> DataFrame:
    """One row a source and one of totals: files, sessions, empty ones, skipped files, details.

    ``details`` maps the name of a histogram to the histogram.
    """
    configure(spark)
    check_agent(agent)
    roots = default_roots() if roots is None else roots
    rows = []
    for i, name in enumerate(AGENTS if agent is None else [agent]):
        root, source = roots.get(name), REGISTRY.get(name)
        paths = source.discover(spark, root) if root and source else []
        skipped = source_b.count_compressed(spark, root) if name == SOURCE_B and root else 0
        details: dict[str, DataFrame] = {}
        empty = spark.range(1).select(F.lit(0).cast("bigint").alias("empty_sessions"))
        if paths:
            index = source.parse(spark, paths, i)
            empty = index.sessions.agg(F.count_if(F.col("message_count") == 0).alias("empty_sessions"))
            lines = lines_of(read_texts(spark, [p for p in paths if not p.endswith(".json")]))
            if name == SOURCE_A:
                missing = index.tool_calls.agg(unmatched_uses(index.tool_calls).alias("n"))
                details = {"unmatched_tool_uses": missing.select(F.create_map(F.lit("count"), "n").alias("histogram"))}
            elif name == SOURCE_B:
                details = diagnose_b(lines, format_of(files_frame(spark, name, i, paths).select("file_path"), lines))
            elif name == SOURCE_C:
                details = diagnose_c(lines)
        named = [d.select(F.struct(F.lit(k).alias("k"), F.coalesce("histogram", F.expr(EMPTY_HISTOGRAM)).alias("v")).alias("e")) for k, d in details.items()]
        told = spark.range(1).select(F.expr(f"cast(map() as map<string,map<string,bigint>>)").alias("details"))
        for d in named:
            told = told.crossJoin(d).select(F.map_concat("details", F.map_from_entries(F.array("e"))).alias("details"))
        row = spark.createDataFrame([(i, name, root, len(paths), len(paths), skipped)], "ord int, agent string, root string, files bigint, sessions bigint, skipped_compressed bigint")
        rows.append(row.crossJoin(empty).crossJoin(told))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return with_totals(out).orderBy("ord").drop("ord")


def with_totals(out: DataFrame) -> DataFrame:
    """The rows of sources and one of their sums, last in ``ord``."""
    sums = [F.sum(c).alias(c) for c in ("files", "sessions", "skipped_compressed", "empty_sessions")]
    total = out.agg(*sums).withColumns({"ord": F.lit(1000), "agent": F.lit("total"), "root": F.lit(None).cast("string"), "details": F.expr("cast(map() as map<string,map<string,bigint>>)")})
    return out.unionByName(total)
