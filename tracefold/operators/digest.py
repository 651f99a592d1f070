"""Substance and digest of all sessions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions.text import cut, is_blank
from ..functions.timex import minutes_between
from ..model import SOURCE_A, SOURCE_B, TIERS, Index

#: Tool names by use (fixed values).
WRITE_TOOLS = {SOURCE_A: ["Write", "Edit", "MultiEdit", "NotebookEdit"], SOURCE_B: ["apply_patch"]}
READ_TOOLS = {SOURCE_A: ["Read"]}
SHELL_TOOLS = ["Bash", "exec_command", "shell_command", "shell", "run_command"]
#: Tier thresholds, idle limits and list caps (fixed values).
THRESHOLDS = [3, 25, 100, 400]
IDLE_MINUTES, IDLE_CALLS = 120, 10
CAP_ERRORS, CAP_SUMMARIES, CAP_FINAL = 20, 50, 3
#: Commands that run tests (fixed values).
RUNNERS = ["npm test", r"pnpm\s+(-r\s+)?test", "yarn test", "vitest", "pytest", "cargo test", "go test", "jest", "maven test", "mvn test", "gradle test", "rake test", "dotnet test"]
RUNNER = r"(?<![A-Za-z0-9_])(" + "|".join(RUNNERS) + r")(?![A-Za-z0-9_])"
#: What outputs say of tests that failed and that passed (fixed values).
FAILED = r"(?i)(^|\s)(FAIL(?![A-Za-z0-9_])|✗|✘|(?<![A-Za-z0-9_])\d+\s+failing(?![A-Za-z0-9_])|tests?\s+failed|ERR_|panic|Traceback)"
PASSED = r"(?i)(✓|✔|(?<![A-Za-z0-9_])\d+\s+passing(?![A-Za-z0-9_])|tests?\s+passed|Test Suite:.*passed)"
PATCH_FILE = r"(?m)\*\*\* (?:Update|Add|Delete) File: (.+)$"


def patch_files(text: Column) -> Column:
    """Paths that a patch names, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PATCH_FILE), F.lit(1)), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.coalesce(F.filter(found, lambda p: p != ""), F.array().cast("array<string>"))


def command_of(value: str = "input") -> Column:
    """The command in a shell tool's input: a string, or the last of an array of strings."""

    def pick(path: str) -> str:
        items = J.array(value, path)
        last = f"case when size({items}) > 0 and forall({items}, x -> {J.kind('x')} = 'STRING') then {J.string(f'element_at({items}, -1)')} end"
        return f"nullif(coalesce({J.string(value, path)}, {last}), '')"

    return F.expr(f"coalesce({pick('$.command')}, {pick('$.action.command')})")


def tier_of(score: Column) -> Column:
    out = F.lit(TIERS[-1])
    for limit, tier in reversed(list(zip(THRESHOLDS, TIERS))):
        out = F.when(score < limit, tier).otherwise(out)
    return out


def test_outcome(agent: Column, output: Column) -> Column:
    """True, false or unknown: an exit code where source B has one, else what the text says.

    The row has ``parsed_output``, the output as a variant where it may hold an exit code.
    """
    code = F.when((agent == SOURCE_B) & F.expr(J.is_number("parsed_output", "$.metadata.exit_code")), F.expr("try_variant_get(parsed_output, '$.metadata.exit_code', 'double')"))
    text = F.when(output.rlike(FAILED), F.lit(False)).when(output.rlike(PASSED), F.lit(True))
    return F.when(F.coalesce(output, F.lit("")) == "", F.lit(None).cast("boolean")).when(code.isNotNull(), code == 0).otherwise(text)


def classified_calls(index: Index) -> DataFrame:
    """Tool calls with what they wrote, read and ran."""
    calls = index.tool_calls.join(index.sessions.select("file_path", "agent"), "file_path")
    named = lambda tools: F.exists(F.array(*[F.struct(F.lit(a), F.lit(n)) for a, ns in tools.items() for n in ns]), lambda t: t == F.struct(F.col("agent"), F.col("name")))
    calls = calls.withColumn("own_path", F.expr(J.filled("input", "$.file_path"))).withColumn("patch", F.expr(J.string("input")))
    one = F.when(F.col("own_path").isNotNull(), F.array("own_path")).otherwise(F.array().cast("array<string>"))
    wrote = F.when(~named(WRITE_TOOLS), F.array().cast("array<string>")).when(F.col("agent") == SOURCE_B, patch_files(F.col("patch"))).otherwise(one)
    calls = calls.withColumn("wrote", wrote).withColumn("saw", F.when(named(READ_TOOLS), one).otherwise(F.array().cast("array<string>")))
    calls = calls.withColumn("is_shell", F.col("name").isin(*SHELL_TOOLS)).withColumn("command", F.when(F.col("is_shell"), command_of()))
    return calls.withColumn("is_test", F.coalesce(F.col("command").rlike(RUNNER), F.lit(False))).drop("own_path", "patch")


def _call_facts(calls: DataFrame) -> DataFrame:
    paths = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    facts = calls.groupBy("file_path").agg(
        F.count("*").alias("tool_call_count"), F.count_if(F.col("status") == "error").alias("error_count"), F.bool_or("is_test").alias("ran_tests"),
        paths("wrote").alias("written"), paths("saw").alias("seen"), F.count_if("is_shell").alias("command_count"),
    )
    return facts.withColumn("read", F.array_except("seen", "written")).drop("seen")


def _message_facts(messages: DataFrame) -> DataFrame:
    last = lambda role: F.max(F.when(F.col("role") == role, F.col("msg_index")))
    return messages.groupBy("file_path").agg(F.coalesce(last("assistant") > last("user"), last("assistant").isNotNull() & last("user").isNull()).alias("ended_cleanly"))


def substance(index: Index) -> DataFrame:
    """Sessions with their signals, score and tier."""
    none = F.array().cast("array<string>")
    facts = _call_facts(classified_calls(index))
    rows = index.sessions.join(facts, "file_path", "left").join(_message_facts(index.messages), "file_path", "left")
    rows = rows.fillna(0, ["tool_call_count", "error_count", "command_count"]).fillna(False, ["ran_tests", "ended_cleanly"])
    rows = rows.withColumn("written", F.coalesce("written", none)).withColumn("read", F.coalesce("read", none))
    rows = rows.withColumn("files_written", F.size("written")).withColumn("files_read", F.size("read"))
    rows = rows.withColumn("duration_min", minutes_between(F.col("started_ts"), F.col("ended_ts")))
    score = F.col("tool_call_count") + 3 * F.col("files_written") + F.col("files_read") + F.when(F.col("ran_tests"), 5).otherwise(0) - F.when(F.col("ended_cleanly"), 0).otherwise(2)
    rows = rows.withColumn("score", score).withColumn("tier", tier_of(F.col("score")))
    idle = (F.col("duration_min") > IDLE_MINUTES) & (F.col("tool_call_count") < IDLE_CALLS)
    return rows.withColumn("idle", F.coalesce(idle, F.lit(False)))


def _ordered(entry: Column, keys: list[str], keep: Column) -> Column:
    """Entries in order as an array, only where ``keep`` holds."""
    rows = F.array_sort(F.collect_list(F.when(keep, F.struct(*keys, entry.alias("entry")))))
    return F.transform(rows, lambda r: r["entry"])


def _among(keep: Column, keys: list, cap: int) -> Column:
    """Whether a row is among the first ``cap`` of a session for which ``keep`` holds.

    Told before rows are gathered, so that no task holds a session's outputs beyond the cap.
    """
    so_far = Window.partitionBy("file_path").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return keep & (F.count_if(keep).over(so_far) <= cap)


def tool_usage(index: Index) -> DataFrame:
    """Calls by tool within a session, most used first, then first seen."""
    used = index.tool_calls.groupBy("file_path", "name").agg(F.count("*").alias("n"), F.min(F.struct("msg_index", "call_index")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("n"), "first"))
    return used.withColumn("rank", rank).select("file_path", "rank", "name", "n")


def digest(index: Index, full: bool = False) -> DataFrame:
    """One row a session: substance, files, tests, commands, errors, tools, summaries, key turns."""
    calls = classified_calls(index).withColumn("parsed_output", F.when((F.col("agent") == SOURCE_B) & F.col("is_test"), F.try_parse_json("output")))
    at = ["msg_index", "call_index"]
    erred = F.col("status") == "error"
    calls = calls.withColumns({"failing": _among(F.col("is_shell") & erred, at, CAP_ERRORS), "erring": _among(erred, at, CAP_ERRORS)})
    tested = F.struct("command", test_outcome(F.col("agent"), F.col("output")).alias("passed"))
    lists = calls.groupBy("file_path").agg(
        _ordered(tested, at, F.col("is_test")).alias("tests"),
        _ordered(F.struct("name", F.col("input_json").alias("input"), "output"), at, F.col("failing")).alias("failing_commands"),
        _ordered(F.struct("name", "output"), at, F.col("erring")).alias("errors"),
    )
    used = tool_usage(index).groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name", "n"))), lambda t: F.struct(t["name"].alias("name"), t["n"].alias("count"))).alias("tool_usage"))
    spoke = ~is_blank(F.col("text"))
    is_summary = (F.col("role") == "summary") & F.col("subtype").isNotNull() & (F.col("subtype") != "")
    answers = (F.col("role") == "assistant") & spoke
    told = index.messages.withColumns({"summing": _among(is_summary, ["msg_index"], CAP_SUMMARIES), "closing": _among(answers, [F.desc("msg_index")], CAP_FINAL)})
    said = told.groupBy("file_path").agg(
        _ordered(F.struct("subtype", cut(F.col("text")).alias("text"), "timestamp", "related"), ["msg_index"], F.col("summing")).alias("summaries"),
        F.min_by(cut(F.col("text")), F.when((F.col("role") == "user") & spoke, F.col("msg_index"))).alias("goal"),
        _ordered(cut(F.col("text")), ["msg_index"], F.col("closing")).alias("final_state"),
    )
    out = substance(index).join(lists, "file_path", "left").join(used, "file_path", "left").join(said, "file_path", "left")
    for c in ("tests", "failing_commands", "errors", "tool_usage", "summaries", "final_state"):
        out = out.withColumn(c, F.coalesce(c, F.array().cast(out.schema[c].dataType)))
    return out.join(transcripts(index), "file_path", "left") if full else out


def transcripts(index: Index) -> DataFrame:
    """One row a session: its messages in order, each with its calls."""
    called = index.tool_calls.groupBy("file_path", "msg_index").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("call_index", "name", F.col("input_json").alias("input"), "status", "output"))), lambda c: c.dropFields("call_index")).alias("tool_calls")
    )
    rows = index.messages.join(called, ["file_path", "msg_index"], "left")
    entry = F.struct("role", "subtype", "text", "timestamp", "related", "stats", F.coalesce("tool_calls", F.array().cast(called.schema["tool_calls"].dataType)).alias("tool_calls"))
    return rows.groupBy("file_path").agg(_ordered(entry, ["msg_index"], F.lit(True)).alias("transcript"))
