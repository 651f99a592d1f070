"""Indexes derived from plain tables, so that every operator runs on Parquet too.

``conversations`` give sessions of turns; ``events`` give sessions of tool calls, a session
a user, with file paths, commands, patches, tokens and references made from the event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timex import iso_millis
from ..model import MESSAGE_STATS, RELATED, SESSION_STATS, SOURCE_A, SOURCE_B, SOURCE_C, Index

_NO_STATS, _NO_LINKS = f"cast(null as {SESSION_STATS})", f"cast(null as {RELATED})"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def agent_of(number: str) -> str:
    return f"case {number} % 3 when 0 then '{SOURCE_A}' when 1 then '{SOURCE_B}' else '{SOURCE_C}' end"


def conversation_index(spark: SparkSession, sf_dir: str) -> Index:
    rows = load(spark, sf_dir, "conversations").selectExpr("conv_id", "cast(turn as int) as turn", "role", "text")
    rows = rows.withColumn("file_path", F.format_string("/c/%08d", "conv_id")).withColumn("agent", F.expr(agent_of("conv_id")))
    start = F.expr("timestamp '2026-06-01 00:00:00' + make_interval(0, 0, 0, 0, cast(conv_id as int))")
    rows = rows.withColumn("ts", start + F.expr("make_interval(0, 0, 0, 0, 0, turn)"))
    ordinal = "cast(conv_id % 3 as int)"
    sessions = rows.groupBy("file_path", "agent", "conv_id").agg(F.min("ts").alias("started_ts"), F.max("ts").alias("ended_ts"), F.count("*").alias("message_count"))
    sessions = sessions.selectExpr(
        "agent", f"{ordinal} as agent_ord", "file_path", "cast(conv_id as int) as file_ord", "format_string('%08d', conv_id) as session_id", "concat('/work/p', conv_id % 7) as project",
        "case when conv_id % 5 = 0 then null else concat('/Home/u', conv_id % 4) end as cwd", "date_format(started_ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") as started_at",
        "date_format(ended_ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") as ended_at", "started_ts", "ended_ts", "concat('m-', conv_id % 2) as model", "message_count", f"{_NO_STATS} as stats",
    )
    messages = rows.withColumn("timestamp", iso_millis(F.col("ts"))).selectExpr(
        "file_path", "agent", "format_string('%08d', conv_id) as session_id", "cast(row_number() over (partition by file_path order by turn) as int) as msg_index", "turn as ord", "0 as sub_ord",
        "role", "cast(null as string) as subtype", "text", "timestamp", "ts", f"{_NO_LINKS} as related", f"cast(null as {MESSAGE_STATS}) as stats",
    )
    return Index.from_frames(sessions, messages, Index.empty(spark).tool_calls)


#: What an event of each type becomes, as SQL over ``k``, ``event_type`` and ``agent``.
EVENT_SQL = {
    "role": "case event_type when 'signup' then 'user' else 'assistant' end",
    "text": "case event_type when 'signup' then concat('start ', k) when 'view' then concat('look at ', k) else '' end",
    "name": f"case event_type when 'view' then 'Read' when 'purchase' then case agent when '{SOURCE_B}' then 'apply_patch' else 'Edit' end when 'click' then 'Bash' when 'error' then 'exec_command' end",
    "path": "concat('/f/', k)",
    "command": "case when k % 10 = 0 then 'npm test' else concat('run ', k) end",
}


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``k`` from their properties, their order within the user, and what they become."""
    rows = load(spark, sf_dir, "events").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "event_type", "value", "cast(get_json_object(props, '$.k') as int) as k")
    rows = rows.withColumn("agent", F.expr(agent_of("user_id"))).withColumn("file_path", F.format_string("/e/%08d", "user_id"))
    rows = rows.withColumn("ord", F.expr("cast(row_number() over (partition by user_id order by ts, event_id) as int)"))
    return rows.withColumns({k: F.expr(v) for k, v in EVENT_SQL.items()})


def event_index(spark: SparkSession, sf_dir: str) -> Index:
    rows = event_rows(spark, sf_dir).persist()
    tokens = F.floor(F.greatest(F.col("value"), F.lit(0.0))).cast("bigint")
    used = F.when((F.col("role") == "assistant") & (F.col("event_id") % 3 == 0), F.struct(tokens, F.col("k").cast("bigint"), tokens * 2, (F.col("k") % 5).cast("bigint"), F.nullif(tokens * 3, F.lit(0).cast("bigint"))).cast(MESSAGE_STATS))
    wrapper = (F.col("agent") == SOURCE_C) & (F.col("event_type") == "signup")
    link = F.array(F.struct(F.lit(SOURCE_B), F.lit("wrapped_session"), F.format_string("%08d", F.col("user_id") - 1), F.when(F.col("k") % 2 == 0, F.concat(F.lit("t"), "k")), F.concat(F.lit("turn"), F.col("k") % 2), F.lit(None).cast("string"))).cast(RELATED)
    rows = rows.withColumn("stats", used).withColumn("related", F.when(wrapper, link))
    total = "case when count(stats) > 0 then struct(sum(stats.input_tokens), sum(stats.output_tokens), sum(stats.cached_input_tokens), sum(stats.reasoning_tokens), cast(10000 as bigint), max_by(stats.context_size, case when stats.context_size is not null then ord end), max(stats.context_size)) end"
    sessions = rows.groupBy("file_path", "agent", "user_id").agg(F.min("ts").alias("started_ts"), F.max("ts").alias("ended_ts"), F.count("*").alias("message_count"), F.expr(total).cast(SESSION_STATS).alias("stats"))
    sessions = sessions.selectExpr(
        "agent", "cast(user_id % 3 as int) as agent_ord", "file_path", "cast(user_id as int) as file_ord", "format_string('%08d', user_id) as session_id", "concat('/work/p', user_id % 7) as project",
        "cast(null as string) as cwd", "date_format(started_ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") as started_at", "date_format(ended_ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") as ended_at",
        "started_ts", "ended_ts", "concat('m-', user_id % 2) as model", "message_count", "stats",
    )
    summary = "event_type = 'signup' and k % 4 = 0"
    messages = rows.withColumn("timestamp", iso_millis(F.col("ts"))).selectExpr(
        "file_path", "agent", "format_string('%08d', user_id) as session_id", "ord as msg_index", "ord", "0 as sub_ord", f"case when {summary} then 'summary' else role end as role",
        f"case when {summary} then 'recap' end as subtype", "text", "timestamp", "ts", "related", "stats",
    )
    body = f"""case name when 'Read' then to_json(struct(path as file_path)) when 'Edit' then to_json(struct(path as file_path))
        when 'Bash' then to_json(struct(command)) when 'exec_command' then to_json(struct(array('bash', '-lc', command) as command))
        when 'apply_patch' then to_json(struct(concat('*** Begin Patch\\n*** Update File: ', path, '\\n*** Add File: /g/', k, '\\n') as p)) end"""
    output = """case event_type when 'error' then case when k % 2 = 0 then '{"metadata":{"exit_code":1}}' else 'tests failed' end
        when 'click' then case when k % 3 = 0 then null when k % 20 = 10 then '3 passing' else concat('done ', k) end else 'ok' end"""
    calls = rows.where("name is not null").withColumn("body", F.expr(body)).withColumn("output", F.expr(output))
    calls = calls.withColumn("input", F.expr("case when name = 'apply_patch' then cast(get_json_object(body, '$.p') as variant) else try_parse_json(body) end"))
    calls = calls.selectExpr(
        "file_path", "ord as msg_index", "0 as call_index", "name", "input", "case when name = 'apply_patch' then get_json_object(body, '$.p') else body end as input_json",
        "case when event_type = 'error' then 'error' when output is null then 'unknown' else 'ok' end as status", "output",
    )
    return Index.from_frames(sessions, messages, calls)
