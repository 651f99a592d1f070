"""Source C: an event log, one JSONL file a session, dispatched on the event type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions.text import basename
from ..model import MESSAGE_STATS, RELATED, SOURCE_B, SOURCE_C, Index
from ..operators.fold import assemble, attach_usage, first_of, last_of, last_title, match_results, message
from .raw import Layout, files_frame, lines_of, list_files, read_texts

AGENT, LAYOUT, DEFAULT_ROOT = SOURCE_C, Layout("", "*.jsonl"), None
#: A provider whose key holds this word ran the conversation underneath.
PROVIDER = "codex"
#: Event types of the log (fixed values).
EVENTS = [
    "session_init", "config", "approval_routing", "approval_policy", "approval_decided", "approval_deferred", "context", "stream", "message",
    "send", "turn_start", "turn_end", "cancel", "interrupted", "loop_start", "loop_end", "notice", "tool_display", "lifecycle", "compaction",
    "memory", "skill", "sub_agent_started", "sub_agent_continued", "sub_agent_finished", "extension",
]


def discover(spark: SparkSession, root: str) -> list[str]:
    return list_files(spark, root, LAYOUT)


def parse(spark: SparkSession, paths: list[str], agent_ord: int = 2) -> Index:
    files = files_frame(spark, AGENT, agent_ord, paths)
    files = files.withColumn("stem", F.regexp_replace(basename(F.col("file_path")), r"\.jsonl$", "")).withColumn("folder_project", F.lit(None).cast("string"))
    return fold(files, lines_of(read_texts(spark, paths)))


def _labelled(pairs: list[tuple[str, str]]) -> str:
    return "concat_ws('\\n\\n', " + ", ".join(f"case when {v} is not null and {v} <> '' then concat('{label}', {v}) end" for label, v in pairs) + ")"


def _strings(path: str) -> str:
    return f"transform({J.array('v', path)}, x -> coalesce({J.string('x')}, to_json(x)))"


def _text(content: str) -> str:
    """A string, or the text parts joined."""
    part = f"case when {J.string('p', '$.type')} = 'text' then nullif(coalesce({J.string('p', '$.text')}, {J.string('p', '$.reasoning')}, ''), '') end"
    return f"coalesce({J.string('v', content)}, array_join(filter(transform({J.array('v', content)}, p -> {part}), t -> t is not null), '\\n'))"


def _pointers() -> str:
    """Thread pointers of the message, then of its parts, in order of appearance."""

    def of(value: str, path: str) -> str:
        entries = f"map_entries(coalesce(case when {J.is_object(value, path)} then try_variant_get({value}, '{path}', 'map<string,variant>') end, cast(map() as map<string,variant>)))"
        return f"transform(filter({entries}, e -> contains(e.key, '{PROVIDER}') and {J.filled('e.value', '$.threadId')} is not null), e -> named_struct('id', {J.filled('e.value', '$.threadId')}, 'turn', {J.filled('e.value', '$.turnId')}, 'path', {J.filled('e.value', '$.threadPath')}))"

    whole = [of("v", f"$.message.{k}") for k in ("providerMetadata", "providerOptions")]
    parts = f"flatten(transform({J.array('v', '$.message.content')}, p -> concat({of('p', '$.providerMetadata')}, {of('p', '$.providerOptions')})))"
    return f"concat({', '.join(whole)}, {parts})"


def fold(files: DataFrame, lines: DataFrame) -> Index:
    """Lines ``(file_path, ord, line, v)`` of source C to an index."""
    key = ["file_path", "ord"]
    rows = lines.where(F.expr(J.is_object("v"))).withColumn("kind", F.expr(J.string("v", "$.type"))).withColumn("time", F.expr(J.string("v", "$.timestamp"))).withColumn("role", F.expr(J.string("v", "$.message.role"))).persist()

    def field(kind: str, path: str):
        return F.when(F.col("kind") == kind, F.expr(J.filled("v", path)))

    u = {k: J.count("v", f"$.usage.{k}") for k in ("inputTokens", "outputTokens", "totalTokens", "reasoningTokens", "cachedInputTokens", "inputTokenDetails.cacheReadTokens", "outputTokenDetails.reasoningTokens")}
    usage = rows.where(F.expr(f"kind = 'turn_end' and {J.is_object('v', '$.usage')}")).select(
        *key,
        F.expr(u["inputTokens"]).alias("i"), F.expr(u["outputTokens"]).alias("o"), F.expr(u["totalTokens"]).alias("t"),
        F.expr(f"coalesce(nullif({u['cachedInputTokens']}, 0L), {u['inputTokenDetails.cacheReadTokens']})").alias("c"),
        F.expr(f"coalesce(nullif({u['reasoningTokens']}, 0L), {u['outputTokenDetails.reasoningTokens']})").alias("r"),
    )
    usage = usage.withColumn("size", F.expr("case when i > 0 then i when t > 0 then t end"))
    usage = usage.withColumn("stats", F.expr("struct(greatest(i - c, 0L), greatest(o - r, 0L), c, r, size)").cast(MESSAGE_STATS))
    totals = usage.groupBy("file_path").agg(*(F.sum(f"stats.{k}").alias(k) for k in ("input_tokens", "output_tokens", "cached_input_tokens", "reasoning_tokens")), last_of(F.col("size")).alias("final"), F.max("size").alias("peak"))
    totals = totals.where("input_tokens + output_tokens + cached_input_tokens + reasoning_tokens > 0 or final is not null")
    totals = totals.select("file_path", F.struct("input_tokens", "output_tokens", "cached_input_tokens", "reasoning_tokens", F.lit(None).cast("bigint"), "final", "peak").alias("stats"))
    header = rows.groupBy("file_path").agg(
        last_of(field("session_init", "$.id")).alias("session_id"),
        F.coalesce(last_of(field("context", "$.cwd")), first_of(field("context", "$.git.root"))).alias("cwd"),
        last_of(field("context", "$.project")).alias("named"),
        last_of(field("config", "$.config.model")).alias("model"),
        first_of(F.nullif("time", F.lit(""))).alias("started_at"),
        last_of(F.nullif("time", F.lit(""))).alias("ended_at"),
    )
    header = header.withColumn("project", F.coalesce("named", "cwd")).drop("named").join(totals, "file_path", "left")

    time = F.col("time")
    said = rows.where(F.expr(f"kind = 'message' and {J.is_object('v', '$.message')}"))
    content = said.withColumn("text", F.expr(_text("$.message.content")))
    plain = content.where("role in ('user', 'system') and text <> ''").select(*key, *message(F.col("role"), F.col("text"), time, sub_ord=1_000_000))

    parts = said.select(*key, "role", "line", "time", F.posexplode(F.expr(J.array("v", "$.message.content"))).alias("i", "p")).withColumn("part", F.expr(J.string("p", "$.type")))
    shown = lambda name: J.raw("line", "$.message.content[", F.col("i").cast("string"), f"].{name}")
    uses = parts.where("role = 'assistant' and part = 'tool-call'").select(
        *key, F.col("i").alias("ix"), F.expr(J.filled("p", "$.toolCallId")).alias("id"), F.expr(f"coalesce({J.string('p', '$.toolName')}, 'unknown')").alias("name"), F.expr(J.at("p", "$.input")).alias("input"), shown("input").alias("input_json")
    )
    busy = uses.select(*key).distinct().withColumn("calls", F.lit(True))
    assistant = content.where("role = 'assistant'").join(busy, key, "left").where("text <> '' or calls")
    turns = assistant.select(*key, *message("assistant", F.col("text"), time, sub_ord=1_000_000))
    given = attach_usage(turns.select(*key), usage.where("i > 0 or o > 0").select(*key, "stats"))
    turns = turns.drop("stats").join(given, key, "left")

    output = F.coalesce(F.expr(J.string("p", "$.output")), F.when(F.expr(J.exists("p", "$.output")), shown("output")))
    failed = f"case when {J.string('p', '$.output.type')} in ('error', 'execution-denied') then 'error' else 'ok' end"
    results = parts.where("role = 'tool' and part = 'tool-result'").select(*key, F.col("i").alias("ix"), F.expr(J.filled("p", "$.toolCallId")).alias("id"), output.alias("output"), F.expr(failed).alias("status"), F.expr(f"coalesce({J.string('p', '$.toolName')}, 'unknown')").alias("name"))
    matched, rest = match_results(uses, results)
    reason, approved = J.string("p", "$.reason"), J.at("p", "$.approved")
    request = F.to_json(F.struct(F.expr(J.string("p", "$.approvalId")).alias("approvalId"), F.expr(f"try_variant_get({approved}, '$', 'boolean')").alias("approved"), F.expr(reason).alias("reason")))
    approvals = parts.where("role = 'tool' and part = 'tool-approval-response'").select(
        *key, F.col("i").alias("ix"), F.lit("tool_approval").alias("name"), request.alias("input_json"), F.expr(f"case when try_variant_get({approved}, '$', 'boolean') = false then 'error' else 'ok' end").alias("status"), F.expr(reason).alias("output")
    )
    residual = rest.select(*key, "ix", "name", F.lit(None).cast("string").alias("input_json"), "status", "output").unionByName(approvals).withColumn("input", F.try_parse_json("input_json"))
    lone = residual.select(*key).distinct().withColumn("calls", F.lit(True))
    spoken = said.where("role = 'tool'").withColumn("text", F.expr(J.string("v", "$.message.content"))).join(lone, key, "left").where("text is not null or calls")
    tools = spoken.select(*key, *message("tool", F.coalesce("text", F.lit("")), time, sub_ord=1_000_000))
    done = uses.join(matched, [*key, "ix"], "left").withColumn("status", F.coalesce("status", F.lit("unknown")))
    columns = [*key, "ix", "name", "input", "input_json", "status", "output"]
    calls = done.select(*columns).unionByName(residual.select(*columns))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("file_path", "ord").orderBy("ix")) - 1
    calls = calls.withColumn("call_index", place).withColumn("sub_ord", F.lit(1_000_000)).drop("ix")

    threads = said.select(*key, "time", F.posexplode(F.expr(_pointers())).alias("k", "t"))
    first = F.row_number().over(Window.partitionBy("file_path", "t.id").orderBy("ord", "k"))
    threads = threads.withColumn("nth", first).where("nth = 1")
    about = "concat_ws('\\n', concat('Original session: ', t.id), concat('First observed turn: ', t.turn), concat('Session file: ', t.path))"
    ref = F.expr(f"array(named_struct('agent', '{SOURCE_B}', 'kind', 'wrapped_session', 'session_id', t.id, 'title', cast(null as string), 'turn_id', t.turn, 'path', t.path))").cast(RELATED)
    wrapped = threads.select(*key, *message("summary", F.expr(about), time, "wrapped_session", ref, sub_ord=F.col("k")))

    memory = _labelled([("Memory: ", J.filled("v", "$.title"))])
    parts_of = _labelled([("Goal: ", J.string("v", "$.goal")), ("Status: ", J.string("v", "$.status")), ("", J.string("v", "$.summary"))])
    steps = f"case when size({J.array('v', '$.nextSteps')}) > 0 then concat('Next steps:\\n', array_join(transform({_strings('$.nextSteps')}, s -> concat('- ', s)), '\\n')) end"
    lists = [f"case when size({J.array('v', p)}) > 0 then concat('{label}: ', array_join({_strings(p)}, ', ')) end" for label, p in (("Tags", "$.tags"), ("Resources", "$.resources"))]
    weight = f"case when {J.is_number('v', '$.importance')} then concat('Importance: ', to_json({J.at('v', '$.importance')})) end"
    recalled = f"concat_ws('\\n\\n', coalesce(nullif({memory}, ''), 'Memory'), nullif({parts_of}, ''), {steps}, {', '.join(lists)}, {weight})"
    either = f"({J.is_number('v', '$.turnCount')} or {J.is_number('v', '$.historyLength')})"
    shown_n = lambda p: f"coalesce(to_json({J.at('v', p)}), '?')"
    prefix = f"case when {either} then concat('Compaction after ', {shown_n('$.turnCount')}, ' turns / ', {shown_n('$.historyLength')}, ' history messages.') else 'Compaction' end"
    squeezed = f"concat_ws('\\n\\n', {prefix}, nullif({_labelled([('Guidance: ', J.string('v', '$.guidance')), ('', J.string('v', '$.summary'))])}, ''))"
    summaries = rows.where("kind = 'memory'").select(*key, *message("summary", F.expr(recalled), time, "memory")).unionByName(
        rows.where("kind = 'compaction'").select(*key, *message("summary", F.expr(squeezed), time, "compaction"))
    )
    notice = rows.where(F.expr(f"kind = 'notice' and coalesce({J.string('v', '$.variant')}, 'info') <> 'debug' and {J.filled('v', '$.text')} is not null"))
    notices = notice.select(*key, *message("system", F.expr(f"concat('[', coalesce({J.string('v', '$.variant')}, 'info'), '] ', {J.string('v', '$.text')})"), time, "notice"))
    errors = rows.where(F.expr(f"kind = 'turn_end' and {J.filled('v', '$.error')} is not null")).select(*key, *message("system", F.expr(f"concat('[error] ', {J.string('v', '$.error')})"), time))
    cancels = rows.where("kind = 'cancel'").select(*key, *message("system", F.lit("Cancellation requested."), time))

    agents = rows.where("kind in ('sub_agent_started', 'sub_agent_continued', 'sub_agent_finished')").select(
        *key, "kind", "time", F.expr(J.filled("v", "$.subAgentId")).alias("key"), F.expr(J.filled("v", "$.title")).alias("title"), F.expr(J.string("v", "$.agent")).alias("agent_name"),
        *(F.expr(J.string("v", f"$.{n}")).alias(n) for n in ("task", "result", "status", "turn_id")), F.expr(J.string("v", "$.subAgentId")).alias("raw_id"),
    )
    agents = last_title(agents.withColumn("remembered", F.expr("case when kind <> 'sub_agent_finished' and key is not null then title end")))
    named = "case when title is not null then concat(': ', title) else '' end"
    told = f"""case kind when 'sub_agent_started' then concat('Sub-agent ', coalesce(agent_name, raw_id, 'unknown'), ' started', {named}, '\\n\\n', coalesce(task, ''))
        when 'sub_agent_continued' then concat('Sub-agent ', coalesce(raw_id, 'unknown'), ' continued', {named}, '\\n\\n', coalesce(task, ''))
        else concat('Sub-agent ', coalesce(raw_id, 'unknown'), ' finished (', coalesce(status, 'unknown'), ').\\n\\n', coalesce(result, '')) end"""
    ref = F.expr(f"case when key is not null then array(named_struct('agent', '{AGENT}', 'kind', 'sub_agent', 'session_id', key, 'title', known, 'turn_id', nullif(turn_id, ''), 'path', cast(null as string))) end").cast(RELATED)
    helpers = agents.select(*key, *message("summary", F.regexp_replace(F.expr(told), "^\\s+|\\s+$", ""), time, "sub_agent", ref))

    messages = plain
    for more in (turns, tools, wrapped, summaries, notices, errors, cancels, helpers):
        messages = messages.unionByName(more)
    return assemble(files, header, messages, calls)
