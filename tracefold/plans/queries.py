"""One query for each operator over the plain tables, and its equivalent in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import timex
from ..model import AGENTS, MESSAGE_STATS, SOURCE_A, SOURCE_B, SOURCE_C, Index
from ..operators import digest as D
from ..operators import doctor, filters, fold, publish, redact, related, stats
from ..operators import search as S
from ..sources import scan, source_a, source_b, source_c, stats_cache
from ..sources.raw import lines_of
from ..streaming import windows
from . import commands
from .derived import conversation_index, event_index, event_rows, load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def pipe(c) -> F.Column:
    """An array of strings as one text, so that both engines hash it alike."""
    return F.coalesce(F.array_join(c, "|"), F.lit(""))


# The derived indexes in SQL.
_AGENT = f"case {{}} % 3 when 0 then '{SOURCE_A}' when 1 then '{SOURCE_B}' else '{SOURCE_C}' end"
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%gZ')"
CONV = f"""with t as (select conv_id, turn, role, text, {_AGENT.format('conv_id')} as agent, printf('%08d', conv_id) as session_id,
    row_number() over (partition by conv_id order by turn) as msg_index,
    timestamp '2026-06-01' + to_hours(conv_id) + to_minutes(turn) as ts from conversations),
  s as (select conv_id, agent, session_id, '/work/p' || (conv_id % 7) as project, case when conv_id % 5 = 0 then null else '/Home/u' || (conv_id % 4) end as cwd,
    min(ts) as started_ts, max(ts) as ended_ts, {_ISO.format('min(ts)')} as started_at, {_ISO.format('max(ts)')} as ended_at, 'm-' || (conv_id % 2) as model, count(*) as message_count,
    coalesce(max(case when role = 'assistant' then msg_index end) > max(case when role = 'user' then msg_index end),
      max(case when role = 'assistant' then msg_index end) is not null and max(case when role = 'user' then msg_index end) is null) as clean
    from t group by conv_id, agent, session_id),
  l as (select *, cast(case when clean then 0 else -2 end as bigint) as score, 'trivial' as tier from s) """
EV = f"""with e0 as (select event_id, ts, user_id, event_type, value, cast(json_extract(props, '$.k') as int) as k, {_AGENT.format('user_id')} as agent,
    printf('%08d', user_id) as session_id, '/e/' || printf('%08d', user_id) as file_path, row_number() over (partition by user_id order by ts, event_id) as ord from events),
  e1 as (select *, case when event_type = 'signup' and k % 4 = 0 then 'summary' when event_type = 'signup' then 'user' else 'assistant' end as role,
    case event_type when 'signup' then 'start ' || k when 'view' then 'look at ' || k else '' end as text, '/f/' || k as path,
    case event_type when 'view' then 'Read' when 'purchase' then case agent when '{SOURCE_B}' then 'apply_patch' else 'Edit' end when 'click' then 'Bash' when 'error' then 'exec_command' end as name,
    case when k % 10 = 0 then 'npm test' else 'run ' || k end as cmd,
    case event_type when 'error' then case when k % 2 = 0 then '{{"metadata":{{"exit_code":1}}}}' else 'tests failed' end
      when 'click' then case when k % 3 = 0 then null when k % 20 = 10 then '3 passing' else 'done ' || k end else 'ok' end as output,
    cast(floor(greatest(value, 0)) as bigint) as tok, event_type <> 'signup' and event_id % 3 = 0 as has_stats from e0),
  c as (select *, case when event_type = 'error' then 'error' when output is null then 'unknown' else 'ok' end as status,
    case when name = 'Edit' and agent = '{SOURCE_A}' then [path] when name = 'apply_patch' then [path, '/g/' || k] else [] end as wrote,
    case when name = 'Read' and agent = '{SOURCE_A}' then [path] else [] end as saw,
    name in ('Bash', 'exec_command') as shell, name in ('Bash', 'exec_command') and k % 10 = 0 as test from e1 where name is not null),
  cf as (select file_path, count(*) as calls, count(*) filter (status = 'error') as errors, bool_or(test) as tests, count(*) filter (shell) as shells,
    list_distinct(flatten(list(wrote))) as written, list_distinct(flatten(list(saw))) as seen from c group by file_path),
  mf as (select file_path, agent, session_id, user_id, min(ts) as started_ts, max(ts) as ended_ts, count(*) as message_count,
    coalesce(max(case when role = 'assistant' then ord end) > max(case when role = 'user' then ord end),
      max(case when role = 'assistant' then ord end) is not null and max(case when role = 'user' then ord end) is null) as clean from e1 group by all),
  su as (select mf.*, coalesce(calls, 0) as calls, coalesce(errors, 0) as errors, coalesce(tests, false) as tests, coalesce(shells, 0) as shells,
    list_sort(coalesce(written, [])) as written, list_sort(list_filter(coalesce(seen, []), lambda p: not list_contains(coalesce(written, []), p))) as rd,
    (epoch_us(ended_ts) // 1000 - epoch_us(started_ts) // 1000) / 60000.0 as minutes from mf left join cf using (file_path)),
  sc as (select *, calls + 3 * len(written) + len(rd) + case when tests then 5 else 0 end - case when clean then 0 else 2 end as score from su),
  ti as (select *, case when score < 3 then 'trivial' when score < 25 then 'light' when score < 100 then 'moderate' when score < 400 then 'substantive' else 'heavy' end as tier from sc) """
_LISTED = "agent, session_id, project, cwd, started_at, ended_at, model, message_count, score, tier"
_EV_LISTED = f"select agent, session_id, '/work/p' || (user_id % 7) as project, cast(null as varchar) as cwd, {_ISO.format('started_ts')} as started_at, {_ISO.format('ended_ts')} as ended_at, 'm-' || (user_id % 2) as model, message_count, cast(score as bigint) as score, tier from ti"


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*commands.SUMMARY, F.col("substance.score").cast("bigint").alias("score"), F.col("substance.tier").alias("tier"))


# Listing, filters, sorts.


@query(CONV + f"select {_LISTED} from l")
def list_recent(spark, d):
    return _flat(commands.list_sessions(conversation_index(spark, d)))


@query(EV + _EV_LISTED)
def list_by_importance(spark, d):
    return _flat(commands.list_sessions(event_index(spark, d), sort="importance"))


@query(EV + _EV_LISTED + " where tier in ('moderate', 'substantive', 'heavy')")
def list_min_importance(spark, d):
    return _flat(commands.list_sessions(event_index(spark, d), min_importance="moderate", sort="importance"))


@query(CONV + f"select {_LISTED} from l where started_ts between timestamp '2026-06-01 20:00:00' and timestamp '2026-06-03 23:59:59.999'")
def list_since_until(spark, d):
    return _flat(commands.list_sessions(conversation_index(spark, d), since="2026-06-01T20:00:00Z", until="2026-06-03"))


@query(CONV + f"select {_LISTED} from l where contains(lower(project), 'p3') or coalesce(contains(lower(cwd), 'p3'), false)")
def list_project_substring(spark, d):
    return _flat(commands.list_sessions(conversation_index(spark, d), project="P3"))


@query(CONV + f"select {_LISTED} from l where contains(lower(project), 'home/u1') or coalesce(contains(lower(cwd), 'home/u1'), false)")
def list_cwd_substring(spark, d):
    return _flat(commands.list_sessions(conversation_index(spark, d), project="home/U1"))


@query(CONV + f"select {_LISTED} from l where agent = '{SOURCE_B}'")
def list_agent(spark, d):
    return _flat(commands.list_sessions(conversation_index(spark, d), agent=SOURCE_B))


@query(CONV + f"select {_LISTED} from l where false")
def list_agent_without_source(spark, d):
    return _flat(commands.list_sessions(conversation_index(spark, d), agent="gemini"))


@query(CONV + "select left(session_id, 7) as prefix, count(*) as n, min(session_id) as first_id from s group by 1")
def resolve_prefix_counts(spark, d):
    ids = conversation_index(spark, d).sessions.select("session_id", F.left("session_id", F.lit(7)).alias("prefix"))
    return filters.matching(ids, F.col("prefix")).groupBy("prefix").agg(F.count("*").alias("n"), F.min("session_id").alias("first_id"))


@query(CONV + "select agent, count(*) as sessions, sum(message_count)::bigint as messages from s group by agent")
def union_of_sources(spark, d):
    index = conversation_index(spark, d)
    every = scan.union([Index(*(frame.where(F.col("agent") == a) for frame in (index.sessions, index.messages)), index.tool_calls) for a in AGENTS])
    said = every.messages.groupBy("agent").agg(F.count("*").alias("messages"))
    return every.sessions.groupBy("agent").agg(F.count("*").alias("sessions")).join(said, "agent")


# Search.

_HIT = "agent, session_id, message_index, role, text, timestamp"


@query(CONV + f"select agent, session_id, msg_index as message_index, role, text, {_ISO.format('ts')} as timestamp from t where contains(lower(text), 'the')")
def search_text(spark, d):
    return commands.search(conversation_index(spark, d), "The").select("agent", "session_id", F.col("message_index").cast("bigint"), "role", "text", "timestamp")


_WRAPPED = f"wr as (select distinct a.session_id as wrapper, printf('%08d', a.user_id - 1) as original from e1 a where a.agent = '{SOURCE_C}' and a.event_type = 'signup'), co as (select distinct wrapper from wr where original in (select session_id from mf where agent = '{SOURCE_B}'))"


@query(
    EV + f", {_WRAPPED}, x as (select *, case name when 'Bash' then '{{\"command\":\"' || cmd || '\"}}' when 'exec_command' then '{{\"command\":[\"bash\",\"-lc\",\"' || cmd || '\"]}}' else '' end as body from c where session_id not in (select wrapper from co)) "
    f"select agent, session_id, ord as message_index, role, name as tool_call, case when contains(coalesce(output, ''), 'test') then output else body end as text, {_ISO.format('ts')} as timestamp from x where contains(coalesce(output, ''), 'test') or contains(body, 'test')"
)
def search_tool_io(spark, d):
    hits = commands.search(event_index(spark, d), "TEST").where("tool_call is not null")
    return hits.select("agent", "session_id", F.col("message_index").cast("bigint"), "role", "tool_call", "text", "timestamp")


@query(CONV + f"select agent, session_id, msg_index as message_index, role, text, {_ISO.format('ts')} as timestamp from t where contains(lower(text), 'a') and ts >= timestamp '2026-06-02' and ts <= timestamp '2026-06-02 12:00:00' and agent = '{SOURCE_A}'")
def search_time_window(spark, d):
    hits = commands.search(conversation_index(spark, d), "a", agent=SOURCE_A, since="2026-06-02", until="2026-06-02T12:00:00Z")
    return hits.select("agent", "session_id", F.col("message_index").cast("bigint"), "role", "text", "timestamp")


@query(
    "with x as (select doc_id, text, instr(lower(text), 'ou') - 1 as i, length(text) as n from documents), y as (select *, greatest(0, i - 249) as s, least(n, greatest(0, i - 249) + 500) as e from x) "
    "select doc_id, case when n <= 500 then text when i < 0 then substr(text, 1, 499) || '…' else case when s > 0 then '…' else '' end || substr(text, s + 1, e - s) || case when e < n then '…' else '' end end as snippet from y"
)
def search_snippet(spark, d):
    return load(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), "ou", 500).alias("snippet"))


@query(EV + f", {_WRAPPED} select wrapper as session_id from co")
def search_exclude_wrapped(spark, d):
    return S.condensed_wrappers(event_index(spark, d))


@query(CONV + f"select session_id, msg_index, role, text, {_ISO.format('ts')} as timestamp from t")
def show_transcript_lines(spark, d):
    shown = commands.lines(conversation_index(spark, d)).where("call_index is null")
    return shown.select("session_id", F.col("msg_index").cast("bigint"), "role", "text", "timestamp")


# As-of joins and header rules.

_ASOF = "with e0 as (select user_id, event_type, value, cast(json_extract(props, '$.k') as int) % 10 as k, row_number() over (partition by user_id order by ts, event_id) as ord from events), "


def _asof_sides(spark, d):
    rows = event_rows(spark, d).withColumn("id", (F.col("k") % 10).cast("string")).withColumn("ix", F.lit(0))
    calls = rows.where("event_type = 'click'").select("file_path", "ord", "ix", "id")
    results = rows.where("event_type = 'error'").select("file_path", "ord", "ix", "id", F.col("ord").cast("string").alias("output"), F.when(F.col("k") % 2 == 0, "ok").otherwise("unknown").alias("status"))
    return calls, results


@query(
    "with e0 as (select user_id, event_type, cast(json_extract(props, '$.k') as int) as k0, cast(json_extract(props, '$.k') as int) % 10 as k, row_number() over (partition by user_id order by ts, event_id) as ord from events), "
    "b as (select *, last_value(case when event_type = 'click' then ord end ignore nulls) over (partition by user_id, k order by ord rows between unbounded preceding and current row) as use_ord from e0 where event_type in ('click', 'error')) "
    "select '/e/' || printf('%08d', user_id) as file_path, use_ord as ord, cast(arg_max(ord, ord) as varchar) as output, max(case when k0 % 2 = 0 then 'ok' end) as status from b where event_type = 'error' and use_ord is not null group by user_id, use_ord"
)
def asof_tool_result(spark, d):
    matched, _ = fold.match_results(*_asof_sides(spark, d))
    return matched.select("file_path", F.col("ord").cast("bigint"), "output", "status")


@query(
    _ASOF + "b as (select *, last_value(case when event_type = 'click' then ord end ignore nulls) over (partition by user_id, k order by ord rows between unbounded preceding and current row) as use_ord from e0 where event_type in ('click', 'error')) "
    "select '/e/' || printf('%08d', user_id) as file_path, ord from b where event_type = 'error' and use_ord is null"
)
def unmatched_results(spark, d):
    _, rest = fold.match_results(*_asof_sides(spark, d))
    return rest.select("file_path", F.col("ord").cast("bigint"))


@query(
    _ASOF + "b as (select *, last_value(case when event_type = 'view' then ord end ignore nulls) over (partition by user_id order by ord rows between unbounded preceding and current row) as use_ord from e0 where event_type in ('view', 'purchase')) "
    "select '/e/' || printf('%08d', user_id) as file_path, use_ord as ord, cast(floor(arg_min(value, ord)) as bigint) as input_tokens from b where event_type = 'purchase' and use_ord is not null group by user_id, use_ord"
)
def asof_usage_first_wins(spark, d):
    rows = event_rows(spark, d)
    zero = F.lit(0).cast("bigint")
    usage = rows.where("event_type = 'purchase'").select("file_path", "ord", F.struct(F.floor("value").cast("bigint"), zero, zero, zero, zero).cast(MESSAGE_STATS).alias("stats"))
    given = fold.attach_usage(rows.where("event_type = 'view'").select("file_path", "ord"), usage)
    return given.select("file_path", F.col("ord").cast("bigint"), F.col("stats.input_tokens").alias("input_tokens"))


@query(
    _ASOF + "b as (select *, last_value(case when event_type = 'signup' then 'title ' || ord end ignore nulls) over (partition by user_id, k order by ord rows between unbounded preceding and current row) as known from e0 where event_type in ('signup', 'purchase')) "
    "select '/e/' || printf('%08d', user_id) as file_path, ord, known from b where event_type = 'purchase'"
)
def title_last_known(spark, d):
    rows = event_rows(spark, d).where("event_type in ('signup', 'purchase')").withColumn("key", (F.col("k") % 10).cast("string"))
    title = F.when(F.col("event_type") == "signup", F.concat(F.lit("title "), "ord"))
    known = fold.last_title(rows.select("file_path", "key", "ord", "event_type", title.alias("title"), title.alias("remembered")))
    return known.where("event_type = 'purchase'").select("file_path", F.col("ord").cast("bigint"), "known")


@query(
    _ASOF + "x as (select * from e0) select '/e/' || printf('%08d', user_id) as file_path, arg_min(k, ord) filter (event_type = 'signup') as first_signup, arg_max(k, ord) filter (event_type = 'click') as last_click from x group by user_id"
)
def header_first_last(spark, d):
    k = F.col("k") % 10
    return event_rows(spark, d).groupBy("file_path").agg(fold.first_of(F.when(F.col("event_type") == "signup", k)).alias("first_signup"), fold.last_of(F.when(F.col("event_type") == "click", k)).alias("last_click"))


@query(
    _ASOF + "x as (select * from e0) select '/e/' || printf('%08d', user_id) as file_path, coalesce(arg_max(k, ord) filter (event_type = 'purchase' and value > 50), arg_min(k, ord) filter (event_type = 'view')) as chosen from x group by user_id"
)
def cwd_coalesce_rule(spark, d):
    k = F.col("k") % 10
    last = fold.last_of(F.when((F.col("event_type") == "purchase") & (F.col("value") > 50), k))
    return event_rows(spark, d).groupBy("file_path").agg(F.coalesce(last, fold.first_of(F.when(F.col("event_type") == "view", k))).alias("chosen"))


# Substance and digest.


def _longs(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


@query(EV + "select session_id, message_count, cast(calls as bigint) as tool_call_count, cast(len(written) as bigint) as files_written, cast(len(rd) as bigint) as files_read, cast(errors as bigint) as error_count, tests as ran_tests, clean as ended_cleanly, minutes > 120 and calls < 10 as idle from su")
def substance_signals(spark, d):
    return D.substance(event_index(spark, d)).select("session_id", "message_count", *_longs("tool_call_count", "files_written", "files_read", "error_count"), "ran_tests", "ended_cleanly", "idle")


@query(EV + "select session_id, cast(score as bigint) as score, tier from ti")
def substance_score_tier(spark, d):
    return D.substance(event_index(spark, d)).select("session_id", *_longs("score"), "tier")


@query("select event_id, case when s < 3 then 'trivial' when s < 25 then 'light' when s < 100 then 'moderate' when s < 400 then 'substantive' else 'heavy' end as tier from (select event_id, floor(value * 3) - 2 as s from events)")
def tier_thresholds(spark, d):
    return load(spark, d, "events").select("event_id", D.tier_of(F.floor(F.col("value") * 3) - 2).alias("tier"))


@query(CONV + "select session_id, clean as ended_cleanly from s")
def ended_cleanly(spark, d):
    return D.substance(conversation_index(spark, d)).select("session_id", "ended_cleanly")


@query(EV + "select session_id, round(minutes, 6) as duration_min from su")
def duration_min(spark, d):
    return D.substance(event_index(spark, d)).select("session_id", F.round("duration_min", 6).alias("duration_min"))


@query(EV + "select session_id, array_to_string(written, '|') as written, array_to_string(rd, '|') as read from su")
def files_read_minus_written(spark, d):
    return D.substance(event_index(spark, d)).select("session_id", pipe("written").alias("written"), pipe("read").alias("read"))


@query(EV + ", u as (select file_path, name, count(*) as n, min(ord) as first from c group by all) select file_path, row_number() over (partition by file_path order by n desc, first) as rank, name, n from u")
def tool_usage_ranked(spark, d):
    return D.tool_usage(event_index(spark, d)).select("file_path", *_longs("rank"), "name", "n")


@query(EV + ", f as (select session_id, ord, name || ' ' || output as entry, row_number() over (partition by session_id order by ord) as r from c where status = 'error' and shell) select mf.session_id, coalesce((select cast(max(x.shells) as bigint) from su x where x.session_id = mf.session_id), 0) as total, coalesce(string_agg(entry, '|' order by ord), '') as failing from mf left join f on f.session_id = mf.session_id and r <= 20 group by mf.session_id")
def failing_commands_top20(spark, d):
    entries = F.transform("failing_commands", lambda e: F.concat_ws(" ", e["name"], e["output"]))
    return D.digest(event_index(spark, d)).select("session_id", F.col("command_count").cast("bigint").alias("total"), pipe(entries).alias("failing"))


@query(EV + ", f as (select session_id, ord, name || ' ' || output as entry, row_number() over (partition by session_id order by ord) as r from c where status = 'error') select mf.session_id, coalesce(string_agg(entry, '|' order by ord), '') as errors from mf left join f on f.session_id = mf.session_id and r <= 20 group by mf.session_id")
def errors_top20(spark, d):
    return D.digest(event_index(spark, d)).select("session_id", pipe(F.transform("errors", lambda e: F.concat_ws(" ", e["name"], e["output"]))).alias("errors"))


@query(
    EV + f""", f as (select session_id, ord, cmd || ':' || case when output is null then '?' when agent = '{SOURCE_B}' and output like '{{%' then 'false' when output like 'tests failed%' then 'false' when output like '%passing%' then 'true' else '?' end as entry from c where test)
    select mf.session_id, coalesce(string_agg(entry, '|' order by ord), '') as tests from mf left join f on f.session_id = mf.session_id group by mf.session_id"""
)
def tests_detected(spark, d):
    entries = F.transform("tests", lambda t: F.concat_ws(":", t["command"], F.coalesce(t["passed"].cast("string"), F.lit("?"))))
    return D.digest(event_index(spark, d)).select("session_id", pipe(entries).alias("tests"))


@query("select doc_id, case when text = '' then null when regexp_matches(text, '(?i)(^|\\s)(FAIL\\b|\\b\\d+\\s+failing\\b|tests?\\s+failed|ERR_|panic|Traceback)') then false when regexp_matches(text, '(?i)(\\b\\d+\\s+passing\\b|tests?\\s+passed)') then true end as passed from (select doc_id, text || case doc_id % 4 when 0 then ' 3 failing' when 1 then ' Tests passed' when 2 then ' Traceback' else '' end as text from documents)")
def test_outcome(spark, d):
    tail = F.element_at(F.array(*map(F.lit, (" 3 failing", " Tests passed", " Traceback", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = load(spark, d, "documents").withColumn("output", F.concat("text", tail)).withColumn("parsed_output", F.try_parse_json(F.lit("{}")))
    return docs.select("doc_id", D.test_outcome(F.lit(SOURCE_A), F.col("output")).alias("passed"))


@query(CONV + "select session_id, arg_min(case when length(text) > 4000 then substr(text, 1, 4000) || ' …[truncated]' else text end, msg_index) filter (role = 'user' and regexp_matches(text, '\\S')) as goal from t group by session_id")
def key_turn_goal(spark, d):
    return D.digest(conversation_index(spark, d)).select("session_id", "goal")


@query(CONV + ", f as (select session_id, msg_index, text, row_number() over (partition by session_id order by msg_index desc) as r from t where role = 'assistant' and regexp_matches(text, '\\S')) select s.session_id, coalesce(string_agg(case when length(text) > 4000 then substr(text, 1, 4000) || ' …[truncated]' else text end, '|' order by msg_index), '') as final_state from s left join f on f.session_id = s.session_id and r <= 3 group by s.session_id")
def final_state_last3(spark, d):
    return D.digest(conversation_index(spark, d)).select("session_id", pipe("final_state").alias("final_state"))


@query(EV + ", f as (select session_id, ord, text, row_number() over (partition by session_id order by ord) as r from e1 where role = 'summary') select mf.session_id, coalesce(string_agg('recap ' || text, '|' order by ord), '') as summaries from mf left join f on f.session_id = mf.session_id and r <= 50 group by mf.session_id")
def summaries_top50(spark, d):
    return D.digest(event_index(spark, d)).select("session_id", pipe(F.transform("summaries", lambda s: F.concat_ws(" ", s["subtype"], s["text"]))).alias("summaries"))


@query("select event_id, '/f/' || k || '|/g/' || k as files from (select event_id, cast(json_extract(props, '$.k') as int) as k from events)")
def patch_file_markers(spark, d):
    patch = F.expr("concat('*** Begin Patch\\n*** Update File: /f/', k, ' \\n+x\\n*** Add File: /g/', k, '\\n*** End Patch')")
    return event_rows(spark, d).select("event_id", pipe(D.patch_files(patch)).alias("files"))


@query("select event_id, case k % 4 when 0 then 'run ' || k when 1 then 'last ' || k when 2 then 'deep ' || k end as command from (select event_id, cast(json_extract(props, '$.k') as int) as k from events)")
def command_string_extract(spark, d):
    body = "case k % 4 when 0 then to_json(struct(concat('run ', k) as command)) when 1 then to_json(struct(array('bash', '-lc', concat('last ', k)) as command)) when 2 then to_json(struct(struct(concat('deep ', k) as command) as action)) else to_json(struct(array(1, 2) as command)) end"
    return event_rows(spark, d).withColumn("input", F.try_parse_json(F.expr(body))).select("event_id", D.command_of().alias("command"))


# Statistics.

_TOKENS = "sum(tok)::bigint as total_input_tokens, sum(k)::bigint as total_output_tokens, sum(tok * 2)::bigint as cached_input_tokens, sum(k % 5)::bigint as reasoning_tokens"


@query(EV + f"select session_id, {_TOKENS}, (sum(tok) + sum(k) + sum(tok * 2) + sum(k % 5))::bigint as total_tokens from e1 where has_stats group by session_id")
def stats_session_totals(spark, d):
    return stats.session_stats(event_index(spark, d)).where("stats is not null").select("session_id", *(F.col(f"stats.{t}").alias(t) for t in stats.TOKENS), "total_tokens")


@query(EV + "select session_id, row_number() over (partition by session_id order by ord) as turn, role, tok as input_tokens, cast(k as bigint) as output_tokens, nullif(tok * 3, 0) as context_size from e1 where has_stats")
def stats_per_turn(spark, d):
    return event_index(spark, d).turns().select("session_id", *_longs("turn"), "role", "input_tokens", "output_tokens", "context_size")


_GLOBAL = "count(*) as sessions, count(a) as with_stats, coalesce(sum(a), 0)::bigint as total_input_tokens, coalesce(sum(b), 0)::bigint as total_output_tokens, coalesce(sum(c2), 0)::bigint as cached_input_tokens, coalesce(sum(r), 0)::bigint as reasoning_tokens"
_TOTALS = f", {_WRAPPED}, st as (select session_id, agent, sum(tok) filter (has_stats) as a, sum(k) filter (has_stats) as b, sum(tok * 2) filter (has_stats) as c2, sum(k % 5) filter (has_stats) as r from e1 group by all), hd as (select *, agent = '{SOURCE_B}' and session_id in (select original from wr) as held from st)"


@query(EV + _TOTALS + f" select agent as label, {_GLOBAL} from hd where not held group by agent union all select 'wrapped', {_GLOBAL} from hd where held union all select 'total', {_GLOBAL} from hd where not held")
def stats_global_by_agent(spark, d):
    return stats.global_stats(event_index(spark, d))


@query(EV + _TOTALS + f" select agent as label, {_GLOBAL} from hd where not held and agent = '{SOURCE_B}' group by agent union all select 'wrapped', {_GLOBAL} from hd where held and agent = '{SOURCE_B}' union all select 'total', {_GLOBAL} from hd where not held and agent = '{SOURCE_B}'")
def stats_wrapped_holdout(spark, d):
    return stats.global_stats(event_index(spark, d), SOURCE_B)


@query(EV + "select session_id, max(nullif(tok * 3, 0)) as peak, arg_max(nullif(tok * 3, 0), ord) filter (tok > 0) as final, cast(floor(100.0 * max(nullif(tok * 3, 0)) / 10000 + 0.5) as bigint) as peak_percent from e1 where has_stats group by session_id")
def stats_peak_final_context(spark, d):
    out = stats.session_stats(event_index(spark, d)).where("stats is not null")
    return out.select("session_id", F.col("stats.peak_context_size").alias("peak"), F.col("stats.final_context_size").alias("final"), "peak_percent")


@query("select hour(ts)::bigint as hour, count(*) as n from events group by 1 order by n desc, hour limit 5")
def stats_busiest_hours(spark, d):
    hours = load(spark, d, "events").groupBy(F.hour("ts").cast("bigint").alias("hour")).agg(F.count("*").alias("n"))
    return hours.orderBy(F.desc("n"), "hour").limit(5)


@query(EV + "select 'm-' || (user_id % 2) as model, sum(k)::bigint as output_tokens, row_number() over (order by sum(k) desc, 1) as rank from e1 where has_stats group by user_id % 2, 1")
def stats_model_rank(spark, d):
    rows = event_index(spark, d).sessions.where("stats is not null").groupBy("model").agg(F.sum("stats.total_output_tokens").alias("output_tokens"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("output_tokens"), "model")).cast("bigint"))


# Doctor: lines are made from events and go through the same classification as files.


def _made_lines(spark, d, body: str) -> DataFrame:
    rows = event_rows(spark, d).withColumn("line", F.expr(body))
    return rows.select("file_path", "ord", "line", F.try_parse_json("line").alias("v")).where("v is not null")


_ENVELOPES = """case when user_id % 4 = 0 then to_json(struct(event_type as type)) when event_type = 'signup' then to_json(struct('session_meta' as type, struct(k as id) as payload))
    when event_type = 'error' then to_json(struct(concat('odd', k % 3) as type, struct(k as x) as payload))
    else to_json(struct('response_item' as type, struct(case when event_type = 'click' then concat('new', k % 2) else 'message' end as type, 'user' as role,
      array(struct(case k % 3 when 0 then '<environment_context>' when 1 then '  <user_action> x' else 'do it' end as text)) as content) as payload)) end"""
_SHAPED = "with e as (select user_id, event_type, cast(json_extract(props, '$.k') as int) as k, row_number() over (partition by user_id order by ts, event_id) as ord from events), en as (select * from e where user_id % 4 <> 0)"


def _histogram(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.explode("histogram").alias(name, "n"))


@query(_SHAPED + " select case when user_id % 4 = 0 then 'flat_jsonl' else 'envelope_jsonl' end as shape, count(distinct user_id) as n from e group by 1")
def doctor_format_distribution(spark, d):
    lines = _made_lines(spark, d, _ENVELOPES)
    return _histogram(doctor.histogram(doctor.format_of(lines.select("file_path").distinct(), lines), "shape"), "shape")


def _diagnosed(spark, d, name: str, key: str) -> DataFrame:
    lines = _made_lines(spark, d, _ENVELOPES)
    return _histogram(doctor.diagnose_b(lines, doctor.format_of(lines.select("file_path").distinct(), lines))[name], key)


@query(_SHAPED + ", f as (select user_id, arg_min(k, ord) as k from en where event_type not in ('signup', 'error') group by user_id) select case k % 3 when 0 then 'env_context' when 1 then 'user_action' else 'plain_task' end as marker, count(*) as n from f group by 1")
def doctor_first_marker(spark, d):
    return _diagnosed(spark, d, "first_user_markers", "marker")


@query(_SHAPED + " select 'odd' || (k % 3) as type, count(*) as n from en where event_type = 'error' group by 1")
def doctor_unknown_envelopes(spark, d):
    return _diagnosed(spark, d, "unknown_envelope_types", "type")


@query(_SHAPED + " select 'new' || (k % 2) as type, count(*) as n from en where event_type = 'click' group by 1")
def doctor_unknown_items(spark, d):
    return _diagnosed(spark, d, "unknown_item_types", "type")


@query("select event_type as type, count(*) as n from events where event_type <> 'error' group by 1")
def doctor_unknown_types(spark, d):
    return _histogram(doctor.diagnose_c(_made_lines(spark, d, "to_json(struct(case event_type when 'error' then 'cancel' else event_type end as type))"))["unknown_event_types"], "type")


@query("select case when cast(json_extract(props, '$.k') as int) % 3 = 0 then 'unknown' else cast(cast(json_extract(props, '$.k') as int) % 3 as varchar) end as version, count(*) as n from events where event_type = 'signup' group by 1")
def doctor_schema_versions(spark, d):
    body = "case when event_type = 'signup' then case when k % 3 = 0 then to_json(struct('session_init' as type, 'x' as schemaVersion)) else to_json(struct('session_init' as type, k % 3 as schemaVersion)) end else to_json(struct('send' as type)) end"
    return _histogram(doctor.diagnose_c(_made_lines(spark, d, body))["schema_versions"], "version")


@query(EV + "select agent, count(*) filter (output is null and status = 'unknown') as unmatched from c group by agent")
def doctor_unmatched(spark, d):
    index = event_index(spark, d)
    calls = index.tool_calls.join(index.sessions.select("file_path", "agent"), "file_path")
    return calls.groupBy("agent").agg(doctor.unmatched_uses(calls).alias("unmatched"))


@query(CONV + "select coalesce(agent, 'total') as agent, count(*) as sessions, count(*) filter (message_count < 3) as small from s group by rollup (agent)")
def doctor_totals_rollup(spark, d):
    none = {"root": F.lit(None).cast("string"), "skipped_compressed": F.lit(0).cast("bigint"), "details": F.expr("cast(map() as map<string,map<string,bigint>>)")}
    rows = conversation_index(spark, d).sessions.groupBy("agent", F.col("agent_ord").alias("ord"))
    rows = rows.agg(F.count("*").alias("files"), F.count("*").alias("sessions"), F.count_if(F.col("message_count") < 3).alias("empty_sessions")).withColumns(none)
    return doctor.with_totals(rows).select("agent", "sessions", F.col("empty_sessions").alias("small"))


@query(EV + f", g as (select user_id, k, ord from e1 where agent = '{SOURCE_C}' and event_type = 'signup') select '/e/' || printf('%08d', user_id) as file_path, printf('%08d', user_id - 1) as session_id, 'turn' || (k % 2) as turn_id, arg_min('t' || k, ord) filter (k % 2 = 0) as title from g group by user_id, k % 2")
def related_sessions_distinct(spark, d):
    return related.distinct_related(event_index(spark, d)).select("file_path", "session_id", "turn_id", "title")


# Redaction.


def _redacted(spark, d, mode: str, expr: str = "text", keep: str = "doc_id", name: str = "documents", outputs: tuple[str, ...] = ()) -> DataFrame:
    rows = load(spark, d, name).select(keep, F.expr(expr).alias("text"))
    return redact.columns(rows, ["text"], mode, outputs)


def _counted(df: DataFrame, kind: str) -> DataFrame:
    key = df.columns[0]
    return df.select(key, "text", F.col("redactions")[kind].alias("n"))


#: The rules of ``redact.RULES`` for DuckDB's regexes, which have no look-around: kind, modes, pattern, replacement.
_W, _U = "[\\t-\\r ", "[^\\t-\\r \"'<>)}\\]"
_DUCK_VALUE = "=(?:\"[^\"]*\"|'[^']*'|[^\\t-\\r \"'`]+)"
_MARK = "[REDACTED_SECRET]"
_DUCK_RULES = [
    ("env_assignment", "s", f"\\b([A-Z][A-Z0-9_]{{2,}}){_DUCK_VALUE}", "\\1=[REDACTED_ENV]"),
    ("env_assignment", "mc", f"\\b([A-Z][A-Z0-9_]*(?:TOKEN|SECRET|KEY|PASSWORD|PASS|AUTH|CREDENTIAL)[A-Z0-9_]*){_DUCK_VALUE}", "\\1=[REDACTED_ENV]"),
    ("secret_like", "cs", f"\\b((?:[Aa]pple [Dd]eveloper )?[Tt]eam(?:{_W}]+ID)?(?:{_W}]+is)?{_W}]+`?)[A-Z0-9]{{10}}(`?)", f"\\1{_MARK}\\2"),
    ("secret_like", "cs", f"\\b(?:DEVELOPMENT_TEAM(?:{_W}]*=)?|[Aa]pplication-identifier:{_W}]*)`?[A-Z0-9]{{10}}(`?)", f"{_MARK}\\1"),
    ("secret_like", "cs", "\\b([A-Z]{1,9}_DEV_TEAM=`?)[A-Z0-9]{10}(`?)", f"\\1{_MARK}\\2"),
    ("secret_like", "cs", "\\b[0-9A-Fa-f]{8}-[0-9A-Fa-f]{16}\\b", _MARK),
    ("secret_like", "cs", None, _MARK),  # whole runs of ten capitals and digits, both among them
    ("secret_like", "mcs", "\\bsk-[A-Za-z0-9_-]{7,}[A-Za-z0-9_]", _MARK),
    ("secret_like", "mcs", "\\bghp_[A-Za-z0-9_]{8,}", _MARK),
    ("secret_like", "mcs", "\\bglpat-[A-Za-z0-9_-]{7,}[A-Za-z0-9_]", _MARK),
    ("secret_like", "mcs", "\\bpat_[A-Za-z0-9._-]{7,}[A-Za-z0-9_]", _MARK),
    ("secret_like", "mcs", "\\beyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]*[A-Za-z0-9_]", _MARK),
    ("secret_like", "s", "\\b[A-Fa-f0-9]{40,}\\b", _MARK),
    ("secret_like", "s", "(^|[^A-Za-z0-9_])[A-Za-z0-9+/]{48,}={0,2}\\b", f"\\1{_MARK}"),
    ("email", "cs", "(^|[^A-Za-z0-9._%+/-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b", "\\1[REDACTED_EMAIL]"),
    ("url_query", "cs", f"(https?://){_U}/?#@]+@({_U}/?#@]+)(/{_U}?#]*)(?:[?#]{_U}]*)?", "\\1\\2\\3"),
    ("url_query", "cs", f"(https?://){_U}/?#@]+@({_U}/?#@]+)(?:[?#]{_U}]*)?", "\\1\\2/"),
    ("url_query", "cs", f"(https?://{_U}/?#@]+)(/{_U}?#]*)[?#]{_U}]+", "\\1\\2"),
    ("url_query", "cs", f"(https?://{_U}/?#@]+)[?#]{_U}]+", "\\1/"),
    ("home_path", "cs", "/Users/[A-Za-z0-9._-]+(/|\\n?$)", "~\\1"),
    ("home_path", "cs", "/home/[A-Za-z0-9._-]+(/|\\n?$)", "~\\1"),
    ("known_auth_file", "cs", "(?:^|([ ])|[\\t-\\r \"'(])[^\\t-\\r \"'()]*?(?:\\.env(?:\\.[A-Za-z0-9_-]+)?|auth\\.json|\\.npmrc|\\.pem|\\.p8|\\.ssh/[^\\t-\\r \"'()]+)", "\\1[REDACTED_AUTH_PATH]"),
]
_TEN = "len(x) = 10 and regexp_matches(x, '[A-Z]') and regexp_matches(x, '[0-9]')"


def _redacted_sql(mode: str, text: str, cut: int | None = None) -> str:
    """DuckDB query of (doc_id, text, a count a kind) after all rules of a mode."""
    kinds = redact.KINDS
    sql = f"select doc_id, {text} as text, " + ", ".join(f"0 as {k}" for k in kinds) + " from documents"

    def step(kind: str, text: str, n: str) -> str:
        return f"select doc_id, {text} as text, " + ", ".join(f"{k} + {n} as {k}" if k == kind else k for k in kinds) + f" from ({sql})"

    if cut:
        short = f"substr(text, 1, {cut}) || chr(10) || '[... output collapsed; ' || (length(text) - {cut}) || ' chars omitted ...]'"
        sql = step("long_output_collapsed", f"case when length(text) > {cut} then {short} else text end", f"cast(length(text) > {cut} as int)")
    for kind, modes, pattern, put in _DUCK_RULES:
        if mode[0] not in modes:
            continue
        if pattern is None:
            runs, gaps = "regexp_extract_all(text, '[A-Z0-9]+')", "regexp_split_to_array(text, '[A-Z0-9]+')"
            swapped = f"list_transform({runs}, lambda x: case when {_TEN} then '{put}' else x end)"
            sql = step(kind, f"array_to_string(list_transform(list_zip({gaps}, {swapped}), lambda z: z[1] || coalesce(z[2], '')), '')", f"len(list_filter({runs}, lambda x: {_TEN}))")
        else:
            quoted = pattern.replace("'", "''")
            sql = step(kind, f"regexp_replace(text, '{quoted}', '{put}', 'g')", f"len(regexp_extract_all(text, '{quoted}'))")
    return sql


def _redaction(name: str, mode: str, kind: str, spark_text: str = "''", duck_text: str = "''", outputs: tuple[str, ...] = ()) -> None:
    """Register ``name``: the whole texts of the documents, with a literal behind them where texts seldom hold a match."""

    def put(spark, d):
        return _counted(_redacted(spark, d, mode, f"concat(coalesce(text, ''), {spark_text})", outputs=outputs), kind)

    put.__name__ = name
    sql = _redacted_sql(mode, f"coalesce(text, '') || {duck_text}", redact.MAX_OUTPUT[mode] if outputs else None)
    query(f"select doc_id, text, cast({kind} as bigint) as n from ({sql})")(put)


def _same(*parts: str) -> tuple[str, str]:
    """The concatenation of literals and doc_id, for Spark and for DuckDB."""
    return f"concat({', '.join(parts)})", " || ".join(f"({p})" for p in parts)


_redaction("redact_email", "cautious", "email")
_redaction("redact_env_cautious", "cautious", "env_assignment", *_same("' a SECRET_TOKEN=abc'", "doc_id", "' PASSWORD=x b FOO=1'"))
_redaction("redact_env_strict", "strict", "env_assignment", *_same("' a SECRET_TOKEN=abc'", "doc_id", "' PASSWORD=\"x y\" b FOO=1'"))
_redaction("redact_tokens", "minimal", "secret_like", *_same("' x sk-abcdefgh'", "doc_id", "' ghp_abcdefgh'", "doc_id", "', glpat-abcdefgh pat_abcd.efgh eyJa'", "doc_id", "'.b-c.d_e sk-short'"))
_redaction("redact_hex_strict", "strict", "secret_like", *_same("' id '", "md5(cast(doc_id as string))", "md5(concat('x', doc_id))", "' end'"))
_redaction("redact_ten_char", "cautious", "secret_like", *_same("' dev AB12CD34E'", "case when doc_id % 2 = 0 then 'F' else '' end", "', ABCDEFGHIJ 1234567890'"))
_redaction("redact_home", "cautious", "home_path", *_same("' at /Users/u'", "doc_id", "'/x, not /homes/a or /home/a, but /home/v'", "doc_id"))
_redaction("redact_authfile", "cautious", "known_auth_file", *_same("' see conf/.npmrc and a'", "doc_id", "'.pem'"))
_redaction("redact_team_id", "cautious", "secret_like", *_same("' the team ID is `AB'", "lpad(cast(doc_id as string), 8, '0')", "'` ok'"))
_redaction("redact_collapse", "strict", "long_output_collapsed", outputs=("text",))

_EVERY_KIND = _same("' API_KEY=v'", "doc_id", "' sk-abcdefghij me@example.com https://h.org/p?q=1 /home/me/x a/.npmrc'")
_SUMS = ", ".join(f"sum({k}) as {k}" for k in redact.KINDS)
_BY_KIND = f"select {_SUMS} from (" + _redacted_sql("cautious", f"coalesce(text, '') || {_EVERY_KIND[1]}") + ")"


@query(" union all ".join(f"select '{k}' as kind, cast({k} as bigint) as n from ({_BY_KIND})" for k in redact.KINDS))
def redact_counts_by_kind(spark, d):
    return redact.totals(_redacted(spark, d, "cautious", f"concat(coalesce(text, ''), {_EVERY_KIND[0]})"))


@query("select page_id, case when contains(url, '?') or contains(url, '#') then regexp_replace(url, '[?#].*$', '') else url end as text, cast(case when contains(url, '?') or contains(url, '#') then 1 else 0 end as bigint) as n from pages")
def redact_url(spark, d):
    return _counted(_redacted(spark, d, "cautious", "url", "page_id", "pages"), "url_query")


# Scalar functions.


@query("select page_id, coalesce(nullif(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'session') as slug from pages")
def slugify_titles(spark, d):
    return load(spark, d, "pages").select("page_id", T.slugify("url").alias("slug"))


@query("select page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as escaped from pages")
def html_escape(spark, d):
    return load(spark, d, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


@query("select page_id, trim(regexp_replace(html, '\\s+', ' ', 'g'), ' ') as line from pages")
def one_line(spark, d):
    return load(spark, d, "pages").select("page_id", T.one_line(F.col("html")).alias("line"))


@query("select doc_id, case when length(text) > 4000 then substr(text, 1, 4000) || ' …[truncated]' else text end as cut, case when length(text) > 120 then substr(text, 1, 119) || '…' else text end as short from documents")
def truncate_4000(spark, d):
    return load(spark, d, "documents").select("doc_id", T.cut(F.col("text")).alias("cut"), T.ellipsis(F.col("text"), 120).alias("short"))


@query("select doc_id, trim(split_part(text, chr(10), 1)) as line from documents where trim(split_part(text, chr(10), 1)) <> ''")
def first_line(spark, d):
    docs = load(spark, d, "documents").where(F.trim(F.split("text", "\n")[0]) != "")
    return docs.select("doc_id", T.first_line(F.col("text")).alias("line"))


@query("select conv_id, turn, 'intro' || chr(10) || chr(10) || '```py' || chr(10) || 'x' || chr(10) || '```' || chr(10) || chr(10) || 'after ' || turn as text from conversations")
def fence_normalize(spark, d):
    text = F.concat(F.lit("intro\n```py\nx\n```\nafter "), F.col("turn").cast("string"))
    return load(spark, d, "conversations").select("conv_id", "turn", T.fence_normalised(text).alias("text"))


@query("select event_id from events where ts >= timestamp '2024-01-15' - interval 7 day and ts <= timestamp '2024-01-15 23:59:59.999'")
def parse_time_arg(spark, d):
    now = datetime(2024, 1, 15, tzinfo=timezone.utc)
    since, until = timex.parse_time("7d", now), timex.parse_time("2024-01-15", now, "end")
    return load(spark, d, "events").where(timex.within(F.col("ts").cast("timestamp"), since, until)).select("event_id")


@query("select event_id, case when m < 60 then m || ' min' when m < 1440 then (m // 60) || 'h ' || (m % 60) || 'm' else (m // 1440) || 'd ' || ((m // 60) % 24) || 'h' end as span from (select event_id, event_id % 5000 as m from events)")
def duration_text(spark, d):
    return load(spark, d, "events").select("event_id", timex.duration_text((F.col("event_id") % 5000) * 60000).alias("span"))


@query("select o_orderkey, format('{:,}', cast(floor(o_totalprice) as bigint)) as price from orders")
def format_thousands(spark, d):
    return load(spark, d, "orders").select("o_orderkey", F.format_number(F.floor("o_totalprice"), 0).alias("price"))


@query("select c_custkey, replace(replace(c_name, '#', '-'), '-', '/') as path from customer")
def decode_cwd(spark, d):
    return load(spark, d, "customer").select("c_custkey", T.decode_folder(F.translate("c_name", "#", "-")).alias("path"))


@query(f"select event_id, {_ISO.format('ts')} as iso from events")
def iso_millis(spark, d):
    return load(spark, d, "events").select("event_id", timex.iso_millis(F.col("ts")).alias("iso"))


@query("select event_id, case when value > 0 then cast(floor(100.0 * 50 / value + 0.5) as bigint) end as pct from events")
def percent_of(spark, d):
    return load(spark, d, "events").select("event_id", stats.percent(F.lit(50), F.col("value")).alias("pct"))


@query("select conv_id, turn, case role when 'user' then 'User' when 'assistant' then 'Assistant' when 'system' then 'System' end as label, role as class from conversations")
def role_labels(spark, d):
    role = F.col("role")
    return load(spark, d, "conversations").select("conv_id", "turn", T.role_label(role, F.lit(None).cast("string")).alias("label"), T.role_class(role).alias("class"))


@query("select event_id, '{\"k\":' || k || '}' as quoted_of, '\"' || event_type || ' \\\"' || k || '\\\"\"' as quoted from (select event_id, event_type, cast(json_extract(props, '$.k') as int) as k from events)")
def yaml_string(spark, d):
    rows = event_rows(spark, d)
    return rows.select("event_id", F.to_json(F.struct("k")).alias("quoted_of"), T.json_quote(F.concat("event_type", F.lit(' "'), "k", F.lit('"'))).alias("quoted"))


# Reading: lines and folds.


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where event_id % 3 <> 0")
def jsonl_parse_tolerant(spark, d):
    rows = load(spark, d, "events").select(F.col("event_id").cast("string").alias("file_path"), F.concat(F.lit(" \n"), F.when(F.col("event_id") % 3 == 0, F.lit("{oops")).otherwise(F.col("props")), F.lit(" \r\n\nnope")).alias("value"))
    return lines_of(rows).select(F.col("file_path").cast("bigint").alias("event_id"), F.expr("try_variant_get(v, '$.k', 'bigint')").alias("k"))


def _leaves(spark, rows: DataFrame) -> DataFrame:
    """Leaves of the values ``v`` with their paths, level by level as far as any value goes down.

    A recursive query would stop at Spark's limits of rows and levels.
    """
    nested = F.expr("schema_of_variant(v) like 'OBJECT%' or schema_of_variant(v) like 'ARRAY%'")
    leaf = lambda level: level.where(~nested).select("event_id", "path", F.expr("to_json(v)").alias("leaf"))
    level = rows.withColumn("path", F.lit("$"))
    leaves = leaf(level)
    while not (inner := level.where(nested)).isEmpty():
        level = spark.sql("select w.event_id, case when x.key is null then concat(w.path, '[', x.pos, ']') else concat(w.path, '.', x.key) end as path, x.value as v from {inner} w, lateral variant_explode(w.v) x", inner=inner)
        leaves = leaves.unionByName(leaf(level))
    return leaves


@query(
    "with e as (select event_id, user_id, event_type, cast(json_extract(props, '$.k') as int) as k from events) "
    "select event_id, '$.k' as path, k::varchar as leaf from e where k is not null union all select event_id, '$.a.b[0]', coalesce(user_id::varchar, 'null') from e "
    "union all select event_id, '$.a.b[1]', coalesce(k::varchar, 'null') from e union all select event_id, '$.a.event_type', to_json(event_type)::varchar from e where event_type is not null"
)
def variant_recursive_paths(spark, d):
    """Leaves of nested values with their paths."""
    rows = event_rows(spark, d).select("event_id", F.try_parse_json(F.expr("to_json(struct(k, struct(array(user_id, k) as b, event_type) as a))")).alias("v"))
    return _leaves(spark, rows)


def _files(rows: DataFrame) -> DataFrame:
    files = rows.select("file_path").distinct()
    return files.withColumns({"agent": F.lit("x"), "agent_ord": F.lit(0), "file_ord": F.lit(0), "stem": T.basename(F.col("file_path")), "folder_project": F.lit(None).cast("string")})


def _logged(spark, d, body: str) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, d, "conversations").withColumn("file_path", F.format_string("/c/%08d", "conv_id")).withColumn("ord", F.col("turn").cast("int")).withColumn("line", F.expr(body))
    rows = rows.select("file_path", "ord", "line", F.try_parse_json("line").alias("v"))
    return _files(rows), rows


def _folded(index: Index) -> DataFrame:
    return index.messages.select("session_id", F.col("msg_index").cast("bigint"), "role", "text")


@query("select printf('%08d', conv_id) as session_id, row_number() over (partition by conv_id order by turn) as msg_index, role, text from conversations where role in ('user', 'assistant')")
def fold_source_a(spark, d):
    body = "case role when 'user' then to_json(named_struct('message', named_struct('role', role, 'content', text))) else to_json(named_struct('message', named_struct('role', role, 'content', array(named_struct('type', 'text', 'text', text))))) end"
    return _folded(source_a.fold(*_logged(spark, d, body)))


@query("select printf('%08d', conv_id) as session_id, row_number() over (partition by conv_id order by turn) as msg_index, role, text from conversations where role in ('user', 'assistant')")
def fold_source_b(spark, d):
    kind = "case role when 'user' then 'input_text' else 'output_text' end"
    body = f"to_json(named_struct('type', 'response_item', 'timestamp', '2026-01-01T00:00:00Z', 'payload', named_struct('type', 'message', 'role', role, 'content', array(named_struct('type', {kind}, 'text', text)))))"
    files, lines = _logged(spark, d, body)
    return _folded(source_b.fold(files, source_b.classified(lines)))


@query("select printf('%08d', conv_id) as session_id, row_number() over (partition by conv_id order by turn) as msg_index, role, text from conversations where text <> ''")
def fold_source_c(spark, d):
    body = "to_json(named_struct('type', 'message', 'message', named_struct('role', role, 'content', text)))"
    return _folded(source_c.fold(*_logged(spark, d, body)))


def _event_lines(spark, d, body: str) -> tuple[DataFrame, DataFrame]:
    rows = event_rows(spark, d).withColumn("line", F.expr(body))
    rows = rows.where("line is not null").select("file_path", "ord", "line", F.try_parse_json("line").alias("v"))
    return _files(rows), rows


_USES = (
    "with e0 as (select user_id, event_type, cast(json_extract(props, '$.k') as int) as k0, cast(json_extract(props, '$.k') as int) % 10 as k, row_number() over (partition by user_id order by ts, event_id) as ord from events), "
    "b as (select *, last_value(case when event_type = 'click' then ord end ignore nulls) over (partition by user_id, k order by ord rows between unbounded preceding and current row) as use_ord from e0 where event_type in ('click', 'error')), "
    "r as (select user_id, use_ord as ord, arg_max(ord, ord) as last_ord, arg_max(k0, ord) as last_k from b where event_type = 'error' and use_ord is not null group by user_id, use_ord), "
    "u as (select user_id, ord, row_number() over (partition by user_id order by ord) as msg_index from e0 where event_type = 'click') "
)


@query(_USES + "select printf('%08d', u.user_id) as session_id, msg_index, case when last_k is null then 'unknown' when last_k % 2 = 0 then 'error' else 'ok' end as status, 'r' || last_ord as output from u left join r on r.user_id = u.user_id and r.ord = u.ord")
def fold_source_a_calls(spark, d):
    body = """case event_type when 'click' then to_json(named_struct('message', named_struct('role', 'assistant', 'content', array(named_struct('type', 'tool_use', 'id', cast(k % 10 as string), 'name', 'Bash')))))
        when 'error' then to_json(named_struct('message', named_struct('role', 'user', 'content', array(named_struct('type', 'tool_result', 'tool_use_id', cast(k % 10 as string), 'content', concat('r', ord), 'is_error', k % 2 = 0))))) end"""
    index = source_a.fold(*_event_lines(spark, d, body))
    calls = index.tool_calls.join(index.sessions.select("file_path", "session_id"), "file_path")
    return calls.select("session_id", F.col("msg_index").cast("bigint"), "status", "output")


@query(_USES + "select printf('%08d', u.user_id) as session_id, msg_index, case when last_k is null then 'unknown' when last_k % 3 = 0 then 'ok' when last_k % 3 = 1 then 'error' else 'ok' end as status from u left join r on r.user_id = u.user_id and r.ord = u.ord")
def exit_code_status(spark, d):
    code = "case k % 3 when 2 then 'plain text' else to_json(named_struct('metadata', named_struct('exit_code', k % 3))) end"
    body = f"""case event_type when 'click' then to_json(named_struct('type', 'function_call', 'name', 'shell', 'call_id', cast(k % 10 as string), 'arguments', '{{}}'))
        when 'error' then to_json(named_struct('type', 'function_call_output', 'call_id', cast(k % 10 as string), 'output', {code})) end"""
    files, lines = _event_lines(spark, d, body)
    index = source_b.fold(files, source_b.classified(lines))
    calls = index.tool_calls.join(index.sessions.select("file_path", "session_id"), "file_path")
    return calls.select("session_id", F.col("msg_index").cast("bigint"), "status")


@query(EV + "select session_id, coalesce(arg_max(greatest(k * 3 - k, 0), ord), 0)::bigint as total_input_tokens, arg_max(k, ord)::bigint as cached_input_tokens, max(nullif(tok, 0)) as peak, arg_max(tok, ord) filter (tok > 0) as final from e1 where event_type = 'purchase' group by session_id")
def fold_source_b_usage(spark, d):
    body = "case event_type when 'purchase' then to_json(named_struct('type', 'event_msg', 'payload', named_struct('type', 'token_count', 'info', named_struct('total_token_usage', named_struct('input_tokens', k * 3, 'cached_input_tokens', k), 'last_token_usage', named_struct('input_tokens', floor(greatest(value, 0D))))))) end"
    files, lines = _event_lines(spark, d, body)
    out = source_b.fold(files, source_b.classified(lines)).sessions
    return out.select("session_id", "stats.total_input_tokens", "stats.cached_input_tokens", F.col("stats.peak_context_size").alias("peak"), F.col("stats.final_context_size").alias("final"))


@query(EV + "select session_id, sum(k * 3 - k)::bigint as total_input_tokens, sum(k)::bigint as cached_input_tokens, max(nullif(k * 3, 0))::bigint as peak from e1 where event_type = 'purchase' group by session_id having sum(k) > 0")
def fold_source_c_usage(spark, d):
    body = "case event_type when 'purchase' then to_json(named_struct('type', 'turn_end', 'usage', named_struct('inputTokens', k * 3, 'cachedInputTokens', k))) when 'error' then to_json(named_struct('type', 'loop_end', 'usage', named_struct('inputTokens', 999999))) end"
    out = source_c.fold(*_event_lines(spark, d, body)).sessions.where("stats is not null")
    return out.select("session_id", "stats.total_input_tokens", "stats.cached_input_tokens", F.col("stats.peak_context_size").alias("peak"))


@query("select hour(ts)::bigint as hour, count(*) as n from events group by 1")
def stats_cache_hours(spark, d):
    counts = load(spark, d, "events").groupBy(F.hour("ts").cast("string").alias("h")).agg(F.count("*").alias("n"))
    doc = counts.agg(F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("m")).select(F.to_json(F.struct(F.lit(1).alias("version"), F.col("m").alias("hourCounts"), F.array(F.lit(1)).alias("modelUsage"))).alias("value"))
    return stats_cache.coerce(doc).select(F.explode("hour_counts").alias("h", "n")).select(F.col("h").cast("bigint").alias("hour"), "n")


@query(CONV + ", g as (select session_id, arg_min(text, msg_index) filter (role = 'user' and regexp_matches(text, '\\S')) as goal from t group by session_id) select session_id, case when goal is null then 'Session ' || session_id else trim(split_part(case when length(goal) > 4000 then substr(goal, 1, 4000) || ' …[truncated]' else goal end, chr(10), 1)) end as title from g")
def bundle_titles(spark, d):
    return publish.bundles(conversation_index(spark, d), generated_at="t").select("session_id", "title")


@query(CONV + "select session_id, message_count + 0 as messages from s")
def bundle_transcripts(spark, d):
    found = publish.bundles(conversation_index(spark, d), generated_at="t")
    return found.select("session_id", F.size("bundle.session.messages").cast("bigint").alias("messages"))


@query()
def markdown_pages(spark, d):
    """Every conversation as a published page, redacted."""
    found = publish.redacted(publish.bundles(conversation_index(spark, d), generated_at="2026-01-01T00:00:00.000Z", mode="cautious"), "cautious")
    return publish.markdown(found).select("session_id", "slug", "markdown")


@query(CONV + "select session_id, started_at as generated_at from s")
def published_archive(spark, d):
    rows = conversation_index(spark, d).sessions.select("session_id", F.col("started_at").alias("generated_at"), F.concat(F.lit("sessions/"), "session_id").alias("path"))
    return publish.archive(rows).select("session_id", "generated_at")


# Generic relational forms over the star schema.


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def top_k_orders(spark, d):
    return load(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("select coalesce(l_returnflag, '*') as flag, coalesce(l_linestatus, '*') as status, count(*) as n, cast(sum(l_quantity) as bigint) as quantity from lineitem group by rollup (l_returnflag, l_linestatus)")
def rollup_lineitem(spark, d):
    rows = load(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity"))
    return rows.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "quantity")


@query("select n_name, count(*) as orders from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name")
def orders_by_nation(spark, d):
    rows = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("orders"))


# Streaming forms, run over a batch.


@query(
    EV + ", g as (select file_path, ts, case when ts > lag(ts) over (partition by file_path order by ts) + interval 2 hour then 1 when lag(ts) over (partition by file_path order by ts) is null then 1 when ts = lag(ts) over (partition by file_path order by ts) + interval 2 hour then 1 else 0 end as new from e1), "
    "w as (select file_path, ts, sum(new) over (partition by file_path order by ts) as n from g) select file_path, min(ts) as started, max(ts) + interval 2 hour as ended, count(*) as messages from w group by file_path, n"
)
def activity_windows(spark, d):
    out = windows.activity_windows(event_index(spark, d).messages)
    return out.select("file_path", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "messages")


@query(EV + "select agent, date_trunc('hour', ts) as started, count(*) as messages from e1 group by all")
def tumbling_counts(spark, d):
    out = windows.tumbling_counts(event_index(spark, d).messages)
    return out.select("agent", F.col("started").cast("timestamp_ntz").alias("started"), "messages")
