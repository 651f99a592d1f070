"""Source B: rollouts in three shapes that one file may mix line by line.

A ``.json`` file is one document of a session and its items; a ``.jsonl`` line is an
envelope (time, type, payload), a bare header, or a bare item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions.text import SPACE, basename
from ..model import MESSAGE_STATS, SOURCE_B, Index
from ..operators.fold import assemble, attach_usage, first_of, last_of, match_results, message
from .raw import Layout, count_matching, files_frame, lines_of, list_files, read_texts

AGENT, LAYOUT, DEFAULT_ROOT = SOURCE_B, Layout("**", "rollout-*.jsonl,rollout-*.json"), "~/.codex/sessions"
#: Openings of user-role blocks that a runtime wrote, not a person (fixed values).
INJECTED = ["# AGENTS.md instructions for", "<environment_context>", "<user_action>"]
#: Envelope and item types that the format defines (fixed values).
ENVELOPES = ["session_meta", "response_item", "event_msg", "turn_context", "compacted"]
CALLS = ["function_call", "custom_tool_call", "local_shell_call", "web_search_call"]
OUTPUTS = ["function_call_output", "custom_tool_call_output"]
ITEMS = ["message", "reasoning", *CALLS, *OUTPUTS]


def discover(spark: SparkSession, root: str) -> list[str]:
    return list_files(spark, root, LAYOUT)


def count_compressed(spark: SparkSession, root: str) -> int:
    """Compressed rollouts, which are listed but not read."""
    return count_matching(spark, root, "rollout-*.jsonl.zst")


def parse(spark: SparkSession, paths: list[str], agent_ord: int = 1) -> Index:
    name = basename(F.col("file_path"))
    files = files_frame(spark, AGENT, agent_ord, paths)
    files = files.withColumn("stem", F.regexp_replace(name, r"\.(jsonl?|jsonl\.zst)$", "")).withColumn("folder_project", F.lit(None).cast("string"))
    legacy = [p for p in paths if p.endswith(".json")]
    lines = lines_of(read_texts(spark, [p for p in paths if not p.endswith(".json")]))
    return fold(files, classified(lines).unionByName(legacy_rows(read_texts(spark, legacy))))


def classified(lines: DataFrame) -> DataFrame:
    """Lines with ``shape`` (an envelope type, header or item), its ``time``, ``body`` and the body's ``text``."""
    kind = J.string("v", "$.type")
    known = ", ".join(f"'{e}'" for e in ENVELOPES)
    envelope = f"({kind} in ({known}) and ({J.is_object('v', '$.payload')} or {J.is_array('v', '$.payload')}))"
    header = f"({J.string('v', '$.id')} is not null and {J.string('v', '$.timestamp')} is not null and {J.kind('v', '$.type')} is null)"
    shape = F.expr(f"case when {envelope} then {kind} when {header} then 'header' else 'item' end")
    rows = lines.where(F.expr(f"{J.is_object('v')} or {J.is_array('v')}")).withColumn("shape", shape)
    inside = F.col("shape").isin(*ENVELOPES)
    return rows.select(
        "file_path",
        "ord",
        "shape",
        F.when(inside, F.expr(J.string("v", "$.timestamp"))).alias("time"),
        F.when(inside, F.expr(J.at("v", "$.payload"))).otherwise(F.col("v")).alias("body"),
        F.when(inside, J.raw("line", "$.payload")).otherwise(F.col("line")).alias("text"),
    )


def legacy_rows(texts: DataFrame) -> DataFrame:
    """A document's session as a header, its items as items."""
    docs = texts.withColumn("v", F.try_parse_json("value")).where(F.expr(J.is_object("v")))
    head = docs.select("file_path", F.lit(-1).alias("ord"), F.lit("document").alias("shape"), F.lit(None).cast("string").alias("time"), F.expr(J.at("v", "$.session")).alias("body"), F.lit(None).cast("string").alias("text"))
    items = docs.select("file_path", F.posexplode(F.expr(J.array("v", "$.items"))).alias("ord", "body"), "value")
    text = J.raw("value", "$.items[", F.col("ord").cast("string"), "]")
    items = items.where(F.expr(J.is_object("body"))).select("file_path", "ord", F.lit("item").alias("shape"), F.lit(None).cast("string").alias("time"), "body", text.alias("text"))
    return head.unionByName(items)


def _header(rows: DataFrame) -> DataFrame:
    def of(shape: str, path: str):
        return F.when(F.col("shape") == shape, F.expr(J.filled("body", path)))

    time, own = F.nullif("time", F.lit("")), of("header", "$.timestamp")
    begun = F.coalesce(own, of("document", "$.timestamp"))
    info = F.expr(f"case when shape = 'event_msg' and {J.string('body', '$.type')} = 'token_count' and {J.is_object('body', '$.info')} then {J.at('body', '$.info')} end")
    rows = rows.withColumn("info", info)
    window = F.when(F.expr(J.is_number("info", "$.model_context_window")), F.expr("try_variant_get(info, '$.model_context_window', 'bigint')"))
    usage = F.expr(f"case when {J.is_object('info', '$.total_token_usage')} then {J.at('info', '$.total_token_usage')} end")
    size = F.nullif(F.expr(J.count("info", "$.last_token_usage.input_tokens")), F.lit(0).cast("bigint"))
    out = rows.groupBy("file_path").agg(
        last_of(F.coalesce(of("session_meta", "$.id"), of("header", "$.id"), of("document", "$.id"))).alias("session_id"),
        F.coalesce(last_of(of("session_meta", "$.cwd")), first_of(of("turn_context", "$.cwd"))).alias("cwd"),
        first_of(of("turn_context", "$.model")).alias("model"),
        F.coalesce(last_of(begun), first_of(F.coalesce(time, of("session_meta", "$.timestamp")))).alias("started_at"),
        last_of(F.coalesce(time, begun)).alias("ended_at"),
        last_of(window).alias("window"),
        F.max_by("info", F.when(usage.isNotNull(), F.col("ord"))).alias("total"),
        last_of(size).alias("final"),
        F.max(size).alias("peak"),
    )
    n = {k: F.expr(J.count("total", f"$.total_token_usage.{k}")) for k in ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")}
    zero = F.lit(0).cast("bigint")
    stats = F.struct(
        F.greatest(n["input_tokens"] - n["cached_input_tokens"], zero), F.greatest(n["output_tokens"] - n["reasoning_output_tokens"], zero),
        n["cached_input_tokens"], n["reasoning_output_tokens"], F.col("window"), F.col("final"), F.col("peak"),
    )
    some = F.coalesce(F.expr("total is not null"), F.lit(False)) | F.col("window").isNotNull() | F.col("final").isNotNull()
    return out.withColumn("stats", F.when(some, stats)).withColumn("project", F.col("cwd")).drop("window", "total", "final", "peak")


def fold(files: DataFrame, rows: DataFrame) -> Index:
    key = ["file_path", "ord"]
    rows = rows.withColumn("kind", F.expr(J.string("body", "$.type"))).persist()
    items = rows.where("shape in ('item', 'response_item')")
    blocks = J.array("body", "$.content")
    said = f"array_join(filter(transform({blocks}, b -> case when {J.string('b', '$.type')} in ('input_text', 'output_text') then {J.string('b', '$.text')} end), t -> t is not null), '\\n')"
    opening = f"regexp_replace(coalesce({J.string('b', '$.text')}, ''), '^{SPACE}+', '')".replace("\\", "\\\\")
    injected = f"exists({blocks}, b -> " + " or ".join(f"startswith({opening}, '{m}')" for m in INJECTED) + ")"
    talk = items.where("kind = 'message'").withColumn("role", F.expr(J.string("body", "$.role")))
    talk = talk.where(F.expr(f"role = 'assistant' or (role = 'user' and not coalesce({injected}, false))"))
    spoken = talk.select(*key, *message(F.col("role"), F.expr(said), F.col("time")))

    name = f"case kind when 'local_shell_call' then 'shell' when 'web_search_call' then 'web_search' else case when {J.filled('body', '$.namespace')} is not null and {J.filled('body', '$.name')} is not null then concat({J.string('body', '$.namespace')}, {J.string('body', '$.name')}) else coalesce({J.string('body', '$.name')}, 'unknown') end end"
    field = F.expr("case kind when 'custom_tool_call' then 'input' when 'function_call' then 'arguments' else 'action' end")
    raw = J.raw("text", "$.", field)
    args = F.nullif(F.expr(J.string("body", "$.arguments")), F.lit(""))
    value = F.when(F.col("kind") == "function_call", F.coalesce(F.try_parse_json(args), args.cast("variant"))).otherwise(F.expr(f"case kind when 'custom_tool_call' then {J.at('body', '$.input')} else {J.at('body', '$.action')} end"))
    shown = F.when(F.col("kind") == "function_call", F.coalesce(F.when(F.try_parse_json(args).isNotNull(), J.raw(args, "$")), args)).otherwise(raw)
    status = f"case when {J.string('body', '$.status')} in ('completed', 'succeeded') then 'ok' when {J.string('body', '$.status')} in ('failed', 'error') then 'error' else 'unknown' end"
    uses = items.where(F.col("kind").isin(*CALLS)).select(
        *key, F.lit(0).alias("ix"), "time", F.expr(J.filled("body", "$.call_id")).alias("id"), F.expr(name).alias("name"), value.alias("input"), shown.alias("input_json"), F.expr(status).alias("status0")
    )
    acted = uses.select(*key, *message("assistant", F.lit(""), F.col("time")))

    output = F.coalesce(F.expr(J.string("body", "$.output")), F.when(F.expr(J.exists("body", "$.output")), J.raw("text", "$.output")))
    code = J.is_number("try_parse_json(output)", "$.metadata.exit_code")
    outcome = f"case when output is null or output in ('', '0', 'false') then 'unknown' when {code} then case when try_variant_get(try_parse_json(output), '$.metadata.exit_code', 'double') = 0 then 'ok' else 'error' end else 'ok' end"
    results = items.where(F.col("kind").isin(*OUTPUTS)).select(*key, F.lit(0).alias("ix"), F.expr(J.filled("body", "$.call_id")).alias("id"), output.alias("output"))
    matched, _ = match_results(uses, results.where("id is not null").withColumn("status", F.expr(outcome)))
    calls = uses.join(matched, [*key, "ix"], "left").select(*key, F.lit(0).alias("sub_ord"), F.lit(0).alias("call_index"), "name", "input", "input_json", F.coalesce("status", "status0").alias("status"), "output")

    kept = J.string("body", "$.message")
    plural = f"size({J.array('body', '$.replacement_history')})"
    note = f"case when {kept} rlike '[^ \\\\t-\\\\r]' then {kept} else concat('Context compacted: ', {plural}, ' prior message', case when {plural} = 1 then '' else 's' end, ' replaced.') end"
    compacted = rows.where("shape = 'compacted'").select(*key, *message("summary", F.expr(note), F.col("time"), "compaction"))

    last = {k: J.count("body", f"$.info.last_token_usage.{k}") for k in ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")}
    usage = rows.where(F.expr(f"shape = 'event_msg' and {J.string('body', '$.type')} = 'token_count' and {J.is_object('body', '$.info.last_token_usage')}"))
    usage = usage.select(*key, F.expr(f"struct({last['input_tokens']} - {last['cached_input_tokens']}, {last['output_tokens']} - {last['reasoning_output_tokens']}, {last['cached_input_tokens']}, {last['reasoning_output_tokens']}, nullif({last['input_tokens']}, 0L))").cast(MESSAGE_STATS).alias("stats"))
    turns = spoken.unionByName(acted)
    given = attach_usage(turns.where("role = 'assistant'").select(*key), usage)
    turns = turns.drop("stats").join(given.withColumn("role", F.lit("assistant")), [*key, "role"], "left")
    return assemble(files, _header(rows), turns.unionByName(compacted), calls)
