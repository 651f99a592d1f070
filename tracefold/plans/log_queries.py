"""Queries over log lines made from the plain tables, one or more a group of line types, with their SQL.

Importing this module adds them to those of ``queries``: the lines go through the same folds
as files do, and the SQL states what must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import Index
from ..operators.stats import TOKENS
from ..sources import source_a, source_b, source_c
from . import commands
from .derived import event_index, load
from .queries import EV, ORACLES, QUERIES, _event_lines, _files, query

__all__ = ["ORACLES", "QUERIES"]

_E = "with e as (select user_id, event_id, event_type, value, cast(json_extract(props, '$.k') as int) as k, printf('%08d', user_id) as session_id, '/e/' || printf('%08d', user_id) as file_path, row_number() over (partition by user_id order by ts, event_id) as ord from events) "
_NUMBERED = "row_number() over (partition by session_id order by ord) as msg_index"


def _b(spark, d, body: str) -> Index:
    files, lines = _event_lines(spark, d, body)
    return source_b.fold(files, source_b.classified(lines))


def _told(index: Index) -> DataFrame:
    return index.messages.select("session_id", F.col("msg_index").cast("bigint"), "role", "subtype", "text")


def _called(index: Index) -> DataFrame:
    calls = index.tool_calls.join(index.sessions.select("file_path", "session_id"), "file_path")
    return calls.select("session_id", F.col("msg_index").cast("bigint"), "name", "input_json", "status", "output")


def _headed(index: Index) -> DataFrame:
    return index.sessions.select("file_path", "session_id", "project", "cwd", "model", "started_at", "ended_at")


# Source A.


@query(
    _E + f"""select session_id, {_NUMBERED}, case event_type when 'signup' then 'summary' when 'view' then 'user' else 'assistant' end as role, case event_type when 'signup' then 'recap' end as subtype,
    case event_type when 'signup' then 'recap ' || k when 'view' then 'a ' || k || case when k % 3 = 0 then '' else chr(10) || 'b ' || k end else 'done ' || k end as text
    from e where (event_type = 'signup' and k % 2 = 0) or (event_type = 'view' and k % 5 <> 0) or event_type = 'purchase'"""
)
def fold_source_a_blocks(spark, d):
    """Text blocks, recaps, and what is left out: meta lines, answers, thinking."""
    part = lambda kind, text, use="cast(null as string)": f"named_struct('type', {kind}, 'tool_use_id', {use}, 'text', {text})"
    said = lambda role, *parts: f"named_struct('role', '{role}', 'content', array({', '.join(parts)}))"
    both = said("user", part("'text'", "concat('a ', k)"), part("if(k % 3 = 0, 'image', 'text')", "concat('b ', k)"))
    answer = said("user", part("'tool_result'", "'seen'", "'t'"), part("'text'", "'hidden'"))
    done = said("assistant", part("'thinking'", "'hm'"), part("'text'", "concat('done ', k)"))
    body = f"""case event_type when 'signup' then to_json(named_struct('type', 'system', 'subtype', if(k % 2 = 0, 'away_summary', 'other'), 'content', concat('recap ', k)))
        when 'view' then to_json(named_struct('type', 'user', 'isMeta', k % 5 = 0, 'message', {both})) when 'click' then to_json(named_struct('message', {answer}))
        when 'purchase' then to_json(named_struct('message', {done})) else to_json(named_struct('isMeta', true, 'message', named_struct('role', 'user', 'content', 'meta'))) end"""
    return _told(source_a.fold(*_event_lines(spark, d, body)))


_A_USAGE = """case when event_type in ('purchase', 'view') then to_json(named_struct('message', named_struct('role', if(event_type = 'purchase', 'assistant', 'user'), 'content', 'x',
    'usage', named_struct('input_tokens', k, 'output_tokens', k * 2, 'cache_creation_input_tokens', k % 7, 'cache_read_input_tokens', 5 * (k % 3))))) end"""
_A_USED = _E + ", u as (select *, k % 7 + 5 * (k % 3) as cached from e where event_type = 'purchase' and k + k % 7 + 5 * (k % 3) > 0) "


@query(_A_USED + "select session_id, row_number() over (partition by session_id order by ord) as turn, k::bigint as input_tokens, (k * 2)::bigint as output_tokens, cached::bigint as cached_input_tokens, (k + cached)::bigint as context_size from u")
def fold_source_a_turns(spark, d):
    """Usage of answers, turn by turn; that of other roles doesn't count."""
    turns = source_a.fold(*_event_lines(spark, d, _A_USAGE)).turns()
    return turns.select("session_id", F.col("turn").cast("bigint"), "input_tokens", "output_tokens", "cached_input_tokens", "context_size")


@query(_A_USED + "select session_id, sum(k)::bigint as input, sum(k * 2)::bigint as output, sum(cached)::bigint as cached, arg_max(k + cached, ord)::bigint as final, max(k + cached)::bigint as peak from u group by session_id")
def fold_source_a_totals(spark, d):
    out = source_a.fold(*_event_lines(spark, d, _A_USAGE)).sessions.where("stats is not null")
    names = {"input": "total_input_tokens", "output": "total_output_tokens", "cached": "cached_input_tokens", "final": "final_context_size", "peak": "peak_context_size"}
    return out.select("session_id", *(F.col(f"stats.{c}").alias(k) for k, c in names.items()))


# Source B.


def _env(kind: str, payload: str, time: str = "'2026-01-01T00:00:00Z'") -> str:
    return f"to_json(named_struct('type', '{kind}', 'timestamp', {time}, 'payload', {payload}))"


@query(
    _E + f"""select session_id, {_NUMBERED}, case event_type when 'signup' then 'user' else 'summary' end as role, case event_type when 'view' then 'compaction' end as subtype,
    case when event_type = 'signup' then 'task ' || k when k % 2 = 0 then 'sum ' || k else 'Context compacted: ' || (k % 3) || ' prior message' || case when k % 3 = 1 then '' else 's' end || ' replaced.' end as text
    from e where (event_type = 'signup' and k % 4 = 3) or event_type = 'view'"""
)
def fold_source_b_injected(spark, d):
    """Injected openings and other roles are left out; compactions tell what they replaced."""
    said = lambda role, text: f"named_struct('type', 'message', 'role', '{role}', 'content', array(named_struct('type', 'input_text', 'text', {text})))"
    opening = "case k % 4 when 0 then '# AGENTS.md instructions for x' when 1 then '  <environment_context> y' when 2 then '<user_action> z' else concat('task ', k) end"
    gone = "named_struct('message', if(k % 2 = 0, concat('sum ', k), '  '), 'replacement_history', slice(array(7, 8), 1, k % 3))"
    body = f"case event_type when 'signup' then {_env('response_item', said('user', opening))} when 'view' then {_env('compacted', gone)} when 'click' then {_env('response_item', said('developer', repr('rules')))} end"
    return _told(_b(spark, d, body))


@query(
    _E + f"""select session_id, ord as msg_index, case event_type when 'purchase' then 'apply_patch' when 'view' then 'shell' when 'click' then 'web_search' when 'signup' then 'ns.f' else 'unknown' end as name,
    case event_type when 'purchase' then 'p ' || k when 'view' then '{{"command":["ls","' || k || '"]}}' when 'click' then '{{"query":"q' || k || '"}}' when 'signup' then case when k % 2 = 0 then '{{"a":' || k || '}}' else 'not json ' || k end end as input_json,
    case when event_type = 'view' then 'ok' when event_type <> 'purchase' then 'unknown' when k % 5 in (0, 1) then 'ok' when k % 5 in (2, 3) then 'error' else 'unknown' end as status, cast(null as varchar) as output from e"""
)
def fold_source_b_calls(spark, d):
    """The four kinds of calls, their names and inputs, and the status they state themselves."""
    body = """case event_type
        when 'purchase' then to_json(named_struct('type', 'custom_tool_call', 'name', 'apply_patch', 'input', concat('p ', k), 'status', element_at(array('completed', 'succeeded', 'failed', 'error', 'odd'), k % 5 + 1)))
        when 'view' then to_json(named_struct('type', 'local_shell_call', 'status', 'completed', 'action', named_struct('command', array('ls', cast(k as string)))))
        when 'click' then to_json(named_struct('type', 'web_search_call', 'action', named_struct('query', concat('q', k))))
        when 'signup' then to_json(named_struct('type', 'function_call', 'namespace', 'ns.', 'name', 'f', 'arguments', if(k % 2 = 0, concat('{"a":', k, '}'), concat('not json ', k))))
        else to_json(named_struct('type', 'function_call', 'arguments', '')) end"""
    return _called(_b(spark, d, body))


@query(
    _E + """, b as (select *, last_value(case when event_type = 'click' then ord end ignore nulls) over (partition by user_id, k % 10 order by ord rows between unbounded preceding and current row) as use_ord from e where event_type in ('click', 'error')),
    r as (select user_id, use_ord as ord, arg_max(k, ord) as k, bool_or(k % 4 <> 3) as told from b where event_type = 'error' and use_ord is not null group by user_id, use_ord),
    u as (select user_id, session_id, ord, row_number() over (partition by user_id order by ord) as msg_index from e where event_type = 'click')
    select session_id, msg_index, case when told then 'ok' else 'unknown' end as status, case k % 4 when 0 then '{"ok":' || k || '}' when 1 then '[' || k || ',null]' when 2 then 'plain ' || k when 3 then '' end as output from u left join r using (user_id, ord)"""
)
def fold_source_b_outputs(spark, d):
    """Outputs that are objects, lists, texts or empty, as text."""
    result = lambda value: f"to_json(named_struct('type', 'custom_tool_call_output', 'call_id', cast(k % 10 as string), 'output', {value}))"
    listed = "concat('{\"type\":\"function_call_output\",\"call_id\":\"', k % 10, '\",\"output\":[', k, ',null]}')"
    body = f"""case event_type when 'click' then to_json(named_struct('type', 'custom_tool_call', 'name', 'x', 'call_id', cast(k % 10 as string)))
        when 'error' then case k % 4 when 0 then {result("named_struct('ok', k)")} when 1 then {listed} when 2 then {result("concat('plain ', k)")} else {result("''")} end end"""
    return _called(_b(spark, d, body)).select("session_id", "msg_index", "status", "output")


_AT = "'2026-01-01T00:00:' || lpad((k % 60)::varchar, 2, '0') || 'Z'"
_TIME = "concat('2026-01-01T00:00:', lpad(k % 60, 2, '0'), 'Z')"


@query(
    _E + f""", h as (select file_path, arg_max('id' || k, ord) filter (event_type = 'signup') as id, arg_max('/w/' || k, ord) filter (event_type = 'signup' and k % 2 = 0) as own, arg_min('/t/' || k, ord) filter (event_type = 'view') as other,
    arg_min('m' || k, ord) filter (event_type = 'view') as model, arg_min({_AT}, ord) as started_at, arg_max({_AT}, ord) as ended_at from e where event_type in ('signup', 'view') group by file_path)
    select file_path, coalesce(id, file_path[4:]) as session_id, coalesce(own, other) as project, coalesce(own, other) as cwd, model, started_at, ended_at from h"""
)
def fold_source_b_header(spark, d):
    """The last id and folder that are stated, the first model and folder of the turns."""
    meta, turn = "named_struct('id', concat('id', k), 'cwd', if(k % 2 = 0, concat('/w/', k), null))", "named_struct('model', concat('m', k), 'cwd', concat('/t/', k))"
    return _headed(_b(spark, d, f"case event_type when 'signup' then {_env('session_meta', meta, _TIME)} when 'view' then {_env('turn_context', turn, _TIME)} end"))


@query(
    _E + """, b as (select *, last_value(case when event_type in ('view', 'click') then ord end ignore nulls) over (partition by user_id order by ord rows between unbounded preceding and current row) as said from e),
    u as (select session_id, said, arg_min(k, ord) as k from b where event_type = 'purchase' and said is not null group by session_id, said)
    select session_id, row_number() over (partition by session_id order by said) as turn, (2 * k)::bigint as input_tokens, (k - k % 4)::bigint as output_tokens, k::bigint as cached_input_tokens, (k % 4)::bigint as reasoning_tokens, nullif(3 * k, 0)::bigint as context_size from u"""
)
def fold_source_b_turns(spark, d):
    """An answer has the first usage that is counted after it and before the next one."""
    answer = "named_struct('type', 'message', 'role', 'assistant', 'content', array(named_struct('type', 'output_text', 'text', concat('x', k))))"
    used = "named_struct('type', 'token_count', 'info', named_struct('last_token_usage', named_struct('input_tokens', k * 3, 'cached_input_tokens', k, 'output_tokens', k, 'reasoning_output_tokens', k % 4)))"
    turns = _b(spark, d, f"case when event_type in ('view', 'click') then {_env('response_item', answer)} when event_type = 'purchase' then {_env('event_msg', used)} end").turns()
    return turns.select("session_id", F.col("turn").cast("bigint"), "input_tokens", "output_tokens", "cached_input_tokens", "reasoning_tokens", "context_size")


@query("select 'old-' || conv_id as session_id, row_number() over (partition by conv_id order by turn) as msg_index, role, cast(null as varchar) as subtype, text from conversations where role in ('user', 'assistant')")
def fold_source_b_legacy(spark, d):
    """Whole documents of a session and its items."""
    rows = load(spark, d, "conversations").groupBy(F.format_string("/c/%08d.json", "conv_id").alias("file_path"), "conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    items = "transform(all, x -> named_struct('type', 'message', 'role', x.role, 'content', array(named_struct('type', 'input_text', 'text', x.text))))"
    texts = rows.select("file_path", F.expr(f"to_json(named_struct('session', named_struct('id', concat('old-', conv_id), 'timestamp', '2025-04-17T10:00:00Z'), 'items', {items}))").alias("value"))
    return _told(source_b.fold(_files(texts), source_b.legacy_rows(texts)))


# Source C.


@query(
    _E + f""", h as (select file_path, arg_max('s' || k, ord) filter (event_type = 'signup') as id, arg_max('/c/' || k, ord) filter (event_type = 'view' and k % 3 = 0) as own, arg_min('/g/' || k, ord) filter (event_type = 'view') as git,
    arg_max('p' || k, ord) filter (event_type = 'view' and k % 4 = 0) as named, arg_max('m' || k, ord) filter (event_type = 'purchase') as model, arg_min({_AT}, ord) as started_at, arg_max({_AT}, ord) as ended_at from e where event_type in ('signup', 'view', 'purchase') group by file_path)
    select file_path, coalesce(id, file_path[4:]) as session_id, coalesce(named, own, git) as project, coalesce(own, git) as cwd, model, started_at, ended_at from h"""
)
def fold_source_c_header(spark, d):
    """The last id, folder, project and model; the first repository where no folder is stated."""
    body = f"""case event_type when 'signup' then to_json(named_struct('type', 'session_init', 'timestamp', {_TIME}, 'id', concat('s', k)))
        when 'view' then to_json(named_struct('type', 'context', 'timestamp', {_TIME}, 'cwd', if(k % 3 = 0, concat('/c/', k), null), 'project', if(k % 4 = 0, concat('p', k), null), 'git', named_struct('root', concat('/g/', k))))
        when 'purchase' then to_json(named_struct('type', 'config', 'timestamp', {_TIME}, 'config', named_struct('model', concat('m', k)))) end"""
    return _headed(source_c.fold(*_event_lines(spark, d, body)))


@query(
    _E + f""", f as (select *, row_number() over (partition by user_id, k % 3 order by ord) as nth from e where event_type = 'click'),
    m as (select session_id, ord, 1 as sub, 'user' as role, cast(null as varchar) as subtype, 'a ' || k || chr(10) || 'b ' || k as text from e where event_type = 'signup'
    union all select session_id, ord, 1, 'assistant', null, 'c ' || k from f
    union all select session_id, ord, 0, 'summary', 'wrapped_session', 'Original session: th' || (k % 3) || chr(10) || 'First observed turn: t' || k || chr(10) || 'Session file: /p/' || k from f where nth = 1)
    select session_id, row_number() over (partition by session_id order by ord, sub) as msg_index, role, subtype, text from m"""
)
def fold_source_c_wrapped(spark, d):
    """Text parts, and a pointer to a session underneath where its thread is first seen."""
    part = lambda kind, text: f"named_struct('type', '{kind}', 'text', {text})"
    pointer = f"map('@x/{source_c.PROVIDER}', named_struct('threadId', concat('th', k % 3), 'turnId', concat('t', k), 'threadPath', concat('/p/', k)))"
    body = f"""case event_type when 'signup' then to_json(named_struct('type', 'message', 'message', named_struct('role', 'user', 'content', array({part('text', "concat('a ', k)")}, {part('image', "'zz'")}, {part('text', "concat('b ', k)")}))))
        when 'view' then to_json(named_struct('type', 'message', 'message', named_struct('role', 'system', 'content', array({part('text', "''")}))))
        when 'click' then to_json(named_struct('type', 'message', 'message', named_struct('role', 'assistant', 'content', concat('c ', k), 'providerMetadata', {pointer}))) end"""
    return _told(source_c.fold(*_event_lines(spark, d, body)))


@query(
    _E + """, b as (select *, last_value(case when event_type = 'click' then ord end ignore nulls) over (partition by user_id, k % 10 order by ord rows between unbounded preceding and current row) as use_ord from e where event_type in ('click', 'error')),
    r as (select *, case k % 3 when 0 then 'error' when 1 then 'execution-denied' else 'text' end as kind, case when k % 3 < 2 then 'error' else 'ok' end as outcome from b where event_type = 'error'),
    g as (select user_id, use_ord as ord, arg_max('{"type":"' || kind || '","value":"v' || k || '"}', ord) as output, arg_max(outcome, ord) as status from r where use_ord is not null group by user_id, use_ord),
    c as (select session_id, ord, 'bash' as name, '{"command":"run ' || k || '"}' as input_json, coalesce(status, 'unknown') as status, output from e left join g using (user_id, ord) where event_type = 'click'
    union all select session_id, ord, 'bash', null, outcome, '{"type":"' || kind || '","value":"v' || k || '"}' from r where use_ord is null
    union all select session_id, ord, 'tool_approval', '{"approvalId":"a' || k || '","approved":' || (k % 2 = 0)::varchar || case when k % 3 = 0 then ',"reason":"why"' else '' end || '}', case when k % 2 = 0 then 'ok' else 'error' end, case when k % 3 = 0 then 'why' end from e where event_type = 'purchase')
    select session_id, row_number() over (partition by session_id order by ord) as msg_index, name, input_json, status, output from c"""
)
def fold_source_c_calls(spark, d):
    """Calls with their results, results without a call, and approvals."""
    said = lambda role, part: f"to_json(named_struct('type', 'message', 'message', named_struct('role', '{role}', 'content', array({part}))))"
    call = "named_struct('type', 'tool-call', 'toolCallId', cast(k % 10 as string), 'toolName', 'bash', 'input', named_struct('command', concat('run ', k)))"
    result = "named_struct('type', 'tool-result', 'toolCallId', cast(k % 10 as string), 'toolName', 'bash', 'output', named_struct('type', element_at(array('error', 'execution-denied', 'text'), k % 3 + 1), 'value', concat('v', k)))"
    approval = "named_struct('type', 'tool-approval-response', 'approvalId', concat('a', k), 'approved', k % 2 = 0, 'reason', if(k % 3 = 0, 'why', null))"
    body = f"case event_type when 'click' then {said('assistant', call)} when 'error' then {said('tool', result)} when 'purchase' then {said('tool', approval)} end"
    return _called(source_c.fold(*_event_lines(spark, d, body)))


_GAP = "chr(10) || chr(10)"


@query(
    _E + f"""select session_id, {_NUMBERED}, case when event_type in ('signup', 'view') then 'summary' else 'system' end as role, case event_type when 'signup' then 'memory' when 'view' then 'compaction' when 'purchase' then 'notice' end as subtype,
    case event_type when 'signup' then case when k % 3 = 0 then 'Memory' else 'Memory: T' || k end || {_GAP} || 'Goal: G' || k || {_GAP} || 'Status: st' || {_GAP} || 'S' || k || case when k % 2 = 0 then {_GAP} || 'Next steps:' || chr(10) || '- a' || chr(10) || '- b' else '' end || {_GAP} || 'Tags: x, y' || {_GAP} || 'Importance: ' || k
    when 'view' then case when k % 2 = 0 or k % 3 = 0 then 'Compaction after ' || case when k % 2 = 0 then k::varchar else '?' end || ' turns / ' || case when k % 3 = 0 then k::varchar else '?' end || ' history messages.' else 'Compaction' end || {_GAP} || 'Guidance: gd' || {_GAP} || 'S' || k
    when 'purchase' then case when k % 3 = 1 then '[warn] n ' else '[info] n ' end || k when 'click' then 'Cancellation requested.' else '[error] boom ' || k end as text
    from e where event_type in ('signup', 'view', 'click') or (event_type = 'purchase' and k % 3 <> 0) or (event_type = 'error' and k % 2 = 0)"""
)
def fold_source_c_events(spark, d):
    """Memories, compactions, notices, errors and cancellations as messages."""
    body = """case event_type
        when 'signup' then to_json(named_struct('type', 'memory', 'title', if(k % 3 = 0, null, concat('T', k)), 'goal', concat('G', k), 'status', 'st', 'summary', concat('S', k), 'nextSteps', if(k % 2 = 0, array('a', 'b'), null), 'tags', array('x', 'y'), 'importance', k))
        when 'view' then to_json(named_struct('type', 'compaction', 'turnCount', if(k % 2 = 0, k, null), 'historyLength', if(k % 3 = 0, k, null), 'guidance', 'gd', 'summary', concat('S', k)))
        when 'purchase' then to_json(named_struct('type', 'notice', 'variant', case k % 3 when 0 then 'debug' when 1 then 'warn' end, 'text', concat('n ', k)))
        when 'click' then to_json(named_struct('type', 'cancel')) else to_json(named_struct('type', 'turn_end', 'error', if(k % 2 = 0, concat('boom ', k), null))) end"""
    return _told(source_c.fold(*_event_lines(spark, d, body)))


@query(
    _E + f""", s as (select *, case when event_type = 'signup' and k % 2 = 0 then 'T' || k end as title from e where event_type in ('signup', 'view', 'purchase')),
    t as (select *, last_value(title ignore nulls) over (partition by user_id, k % 3 order by ord rows between unbounded preceding and current row) as known from s)
    select session_id, {_NUMBERED}, 'sub_agent' as subtype, case event_type when 'signup' then 'Sub-agent helper started' || coalesce(': ' || title, '') || {_GAP} || 'see ' || k when 'view' then 'Sub-agent s' || (k % 3) || ' continued' || {_GAP} || 'go ' || k
    else 'Sub-agent s' || (k % 3) || ' finished (' || case when k % 5 = 0 then 'unknown' else 'done' end || ').' || case when k % 7 = 0 then '' else {_GAP} || 'got ' || k end end as text, 's' || (k % 3) as child, known as title from t"""
)
def fold_source_c_sub_agents(spark, d):
    """Sub-agents that start, go on and finish, under the last title known of them."""
    body = """case event_type when 'signup' then to_json(named_struct('type', 'sub_agent_started', 'subAgentId', concat('s', k % 3), 'agent', 'helper', 'title', if(k % 2 = 0, concat('T', k), null), 'task', concat('see ', k)))
        when 'view' then to_json(named_struct('type', 'sub_agent_continued', 'subAgentId', concat('s', k % 3), 'task', concat('go ', k)))
        when 'purchase' then to_json(named_struct('type', 'sub_agent_finished', 'subAgentId', concat('s', k % 3), 'status', if(k % 5 = 0, null, 'done'), 'result', if(k % 7 = 0, null, concat('got ', k)))) end"""
    told = source_c.fold(*_event_lines(spark, d, body)).messages
    return told.select("session_id", F.col("msg_index").cast("bigint"), "subtype", "text", F.col("related")[0]["session_id"].alias("child"), F.col("related")[0]["title"].alias("title"))


# Commands over one session, views, and texts.

ONE = "00000003"


@query(EV + f"select e1.ord as msg_index, e1.role, e1.text, c.name, c.status, c.output from e1 left join c using (event_id) where e1.session_id = '{ONE}'")
def show_session(spark, d):
    shown = commands.show(event_index(spark, d), ONE)
    return shown.select(F.col("msg_index").cast("bigint"), "role", "text", "name", "status", "output")


@query(
    EV + f"""select session_id, score::bigint as score, tier, array_to_string(written, '|') as written, array_to_string(rd, '|') as read, errors::bigint as errors, cast(floor(minutes) as bigint) as minutes,
    (select string_agg(name || ' ' || n, '|' order by n desc, first) from (select name, count(*) as n, min(ord) as first from c where session_id = '{ONE}' group by name)) as tools from ti where session_id = '{ONE}'"""
)
def extract_session(spark, d):
    """The digest of one session."""
    found = commands.extract(event_index(spark, d), ONE)
    tools = F.array_join(F.transform("tool_usage", lambda t: F.concat_ws(" ", t["name"], t["count"].cast("string"))), "|")
    sides = (F.array_join(f"files.{side}", "|").alias(side) for side in ("written", "read"))
    signals = F.col("substance.signals.error_count").cast("bigint").alias("errors")
    return found.select("session_id", F.col("substance.score").cast("bigint").alias("score"), "substance.tier", *sides, signals, F.floor("duration_min").alias("minutes"), tools.alias("tools"))


@query(f"select * from ({ORACLES['stats_session_totals']}) where session_id = '{ONE}'")
def stats_one_session(spark, d):
    found = commands.session_stats(event_index(spark, d), ONE).where("stats is not null")
    return found.select("session_id", *(F.col(f"stats.{t}").alias(t) for t in TOKENS), "total_tokens")


@query(EV + "select agent, count(*) as messages, count(distinct session_id) as sessions, count(name) filter (event_type <> 'signup') as calls, count(*) filter (has_stats) as turns from e1 group by agent")
def sql_views(spark, d):
    """The tables of an index by plain SQL."""
    event_index(spark, d).register_views("of_events_")
    count = lambda view: f"select file_path, count(*) as n from of_events_{view} group by file_path"
    return spark.sql(
        f"select s.agent, sum(m.n) as messages, count(*) as sessions, coalesce(sum(c.n), 0) as calls, coalesce(sum(u.n), 0) as turns from of_events_sessions s join ({count('messages')}) m using (file_path)"
        f" left join ({count('tool_calls')}) c using (file_path) left join ({count('turn_usage')}) u using (file_path) group by s.agent"
    )


@query("select doc_id, case when length(text) > 120 then substr(text, 1, 119) || '…' else text end as text from documents")
def ellipsis_120(spark, d):
    return load(spark, d, "documents").select("doc_id", T.ellipsis(F.col("text"), 120).alias("text"))


@query("select p_partkey, case when p_partkey % 3 = 0 then '' else 'd' || (p_partkey % 5) end as parent, 'f' || p_partkey || '.jsonl' as base from part")
def path_parts(spark, d):
    path = F.expr("concat(case when p_partkey % 3 = 0 then '' else concat('/w/d', p_partkey % 5, '/') end, 'f', p_partkey, '.jsonl')")
    return load(spark, d, "part").withColumn("path", path).select("p_partkey", T.parent_name(F.col("path")).alias("parent"), T.basename(F.col("path")).alias("base"))
