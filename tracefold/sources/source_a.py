"""Source A: one JSONL file a session, in one folder a project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions.text import basename, decode_folder, parent_name
from ..model import SOURCE_A, Index
from ..operators.fold import assemble, first_of, last_of, match_results, message
from .raw import Layout, files_frame, lines_of, list_files, read_texts

AGENT, LAYOUT, DEFAULT_ROOT = SOURCE_A, Layout("*", "*.jsonl"), "~/.claude/projects"

_TEXT = "array_join(filter(transform(blocks, b -> case when {is_text} then {text} end), t -> t is not null), '\\n')".format(is_text=J.string("b", "$.type") + " = 'text'", text=J.string("b", "$.text"))


def discover(spark: SparkSession, root: str) -> list[str]:
    return list_files(spark, root, LAYOUT)


def parse(spark: SparkSession, paths: list[str], agent_ord: int = 0) -> Index:
    files = files_frame(spark, AGENT, agent_ord, paths)
    folder = parent_name(F.col("file_path"))
    files = files.withColumn("stem", F.regexp_replace(basename(F.col("file_path")), r"\.jsonl$", "")).withColumn("folder_project", decode_folder(folder))
    return fold(files, lines_of(read_texts(spark, paths)))


def fold(files: DataFrame, lines: DataFrame) -> Index:
    """Lines ``(file_path, ord, line, v)`` of source A to an index."""
    tokens = {k: J.count("v", f"$.message.usage.{k}") for k in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")}
    cols = {
        "session": J.filled("v", "$.sessionId"), "dir": J.filled("v", "$.cwd"), "at": J.filled("v", "$.timestamp"), "stamp": J.string("v", "$.timestamp"),
        "role": J.string("v", "$.message.role"), "plain": J.string("v", "$.message.content"), "blocks": J.array("v", "$.message.content"), "meta": J.is_true("v", "$.isMeta"),
        "recap": f"case when {J.string('v', '$.type')} = 'system' and {J.string('v', '$.subtype')} = 'away_summary' then {J.filled('v', '$.content')} end",
        "used_model": f"case when {J.string('v', '$.message.role')} = 'assistant' then {J.filled('v', '$.message.model')} end",
        "fresh": tokens["input_tokens"], "out": tokens["output_tokens"], "cached": f"{tokens['cache_creation_input_tokens']} + {tokens['cache_read_input_tokens']}",
    }
    rows = lines.where(J.is_object("v")).select("file_path", "ord", "line", *(F.expr(e).alias(k) for k, e in cols.items()))
    stats = F.when(
        (F.col("role") == "assistant") & (F.col("fresh") + F.col("out") + F.col("cached") > 0),
        F.struct(F.col("fresh"), F.col("out"), F.col("cached"), F.lit(0).cast("bigint"), F.col("fresh") + F.col("cached")),
    )
    rows = rows.withColumn("stats", stats.cast("struct<input_tokens:bigint,output_tokens:bigint,cached_input_tokens:bigint,reasoning_tokens:bigint,context_size:bigint>")).persist()

    context = F.when(F.col("stats.context_size") > 0, F.col("stats.context_size"))
    sums = [F.coalesce(F.sum(f"stats.{c}"), F.lit(0)) for c in ("input_tokens", "output_tokens", "cached_input_tokens")]
    header = rows.groupBy("file_path").agg(
        last_of(F.col("session")).alias("session_id"), last_of(F.col("dir")).alias("cwd"), first_of(F.col("at")).alias("started_at"),
        last_of(F.col("at")).alias("ended_at"), last_of(F.col("used_model")).alias("model"), *(s.alias(f"s{i}") for i, s in enumerate(sums)),
        last_of(context).alias("final"), F.max(context).alias("peak"),
    )
    total = F.struct("s0", "s1", "s2", F.lit(0).cast("bigint"), F.lit(None).cast("bigint"), "final", "peak")
    header = header.withColumn("project", F.col("cwd")).withColumn("stats", F.when(F.expr("s0 + s1 + s2 > 0"), total)).drop("s0", "s1", "s2", "final", "peak")

    key, stamp = ["file_path", "ord"], F.col("stamp")
    joined = F.expr(_TEXT)
    answered = F.expr(f"exists(blocks, b -> {J.string('b', '$.type')} = 'tool_result' and {J.filled('b', '$.tool_use_id')} is not null)")
    assistant = rows.where("role = 'assistant'").select(*key, *message("assistant", joined, stamp, stats=F.col("stats")))
    spoken = rows.where("role = 'user' and not meta").withColumn("said", F.when(F.col("plain").isNotNull(), F.col("plain")).otherwise(F.when(~F.coalesce(answered, F.lit(False)), F.nullif(joined, F.lit("")))))
    user = spoken.where("said is not null").select(*key, *message("user", F.col("said"), stamp))
    recap = rows.where("recap is not null").select(*key, *message("summary", F.col("recap"), stamp, "recap", sub_ord=1))
    messages = assistant.unionByName(user).unionByName(recap)

    use = f"filter(transform(blocks, (b, i) -> named_struct('b', b, 'i', i)), x -> {J.string('x.b', '$.type')} = 'tool_use' and {J.filled('x.b', '$.id')} is not null and {J.filled('x.b', '$.name')} is not null)"
    uses = rows.where("role = 'assistant'").select(*key, "line", F.posexplode(F.expr(use)).alias("ix", "x"))
    uses = uses.select(
        *key, "ix", F.expr(J.string("x.b", "$.id")).alias("id"), F.expr(J.string("x.b", "$.name")).alias("name"), F.expr(J.at("x.b", "$.input")).alias("input"),
        J.raw("line", "$.message.content[", F.col("x.i").cast("string"), "].input").alias("input_json"),
    )
    body = f"case when {J.string('b', '$.content')} is not null then {J.string('b', '$.content')} else array_join(transform({J.array('b', '$.content')}, c -> coalesce({J.string('c', '$.text')}, '')), '\\n') end"
    answer = f"filter(transform(blocks, b -> named_struct('t', {J.string('b', '$.type')}, 'id', {J.filled('b', '$.tool_use_id')}, 'output', {body}, 'status', case when {J.is_true('b', '$.is_error')} then 'error' else 'ok' end)), x -> x.t = 'tool_result' and x.id is not null)"
    results = rows.where("role = 'user'").select(*key, F.posexplode(F.expr(answer)).alias("ix", "x")).select(*key, "ix", "x.id", "x.output", "x.status")
    matched, _ = match_results(uses, results)
    calls = uses.join(matched, ["file_path", "ord", "ix"], "left").select(
        *key, F.lit(0).alias("sub_ord"), F.col("ix").alias("call_index"), "name", "input", "input_json", F.coalesce("status", F.lit("unknown")).alias("status"), "output"
    )
    return assemble(files, header, messages, calls)
