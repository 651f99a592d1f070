import logs
import pytest

from tracefold.model import Index
from tracefold.operators import doctor
from tracefold.sources import stats_cache
from tracefold.sources.raw import expand_home
from tracefold.sources.scan import scan


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    top = tmp_path_factory.mktemp("logs")
    logs.source_a(top / "a")
    logs.source_b(top / "b")
    logs.source_c(top / "c")
    return {"claude": str(top / "a"), "codex": str(top / "b"), "eventlog": str(top / "c")}


@pytest.fixture(scope="module")
def index(spark, roots):
    return Index.from_roots(spark, roots)


@pytest.fixture(scope="module")
def sessions(index):
    return {r["session_id"]: r.asDict(recursive=True) for r in index.sessions.collect()}


def messages(index, session):
    rows = index.messages.where(f"session_id = '{session}'").orderBy("msg_index").collect()
    return [r.asDict(recursive=True) for r in rows]


def calls(index, session):
    rows = index.tool_calls.drop("input").join(index.sessions.select("file_path", "session_id"), "file_path").where(f"session_id = '{session}'")
    return [r.asDict() for r in rows.orderBy("msg_index", "call_index").collect()]


def test_every_file_has_a_session(sessions):
    assert set(sessions) == {"aaaa-1", "empty", "garbage", "bbbb", "old-id", "flat-id", "cccc-id"}
    empty = sessions["empty"]
    assert (empty["message_count"], empty["started_at"], empty["ended_at"], empty["project"]) == (0, "", None, "/work/demo")


def test_source_a_header_and_stats(sessions):
    s = sessions["aaaa-1"]
    assert (s["model"], s["cwd"], s["message_count"]) == ("m-2", "/work/demo", 4)
    assert (s["started_at"], s["ended_at"]) == ("2026-06-01T10:00:00.000Z", "2026-06-01T11:30:00.000Z")
    assert list(s["stats"].values()) == [14, 300, 410, 0, None, 310, 310]


def test_source_a_messages_and_calls(index):
    assert [(m["role"], m["text"]) for m in messages(index, "aaaa-1")] == [("user", "Rename the long flag"), ("assistant", "Reading"), ("assistant", "Testing"), ("summary", "We fixed half of it")]
    assert [(c["name"], c["status"], c["output"]) for c in calls(index, "aaaa-1")] == [("Read", "ok", "line one\nline two"), ("Bash", "error", "FAIL 1 test"), ("Edit", "unknown", None)]
    assert calls(index, "aaaa-1")[0]["input_json"] == '{"file_path":"/work/demo/a.py","z":1.0}'


def test_source_b_envelopes(index, sessions):
    s = sessions["bbbb"]
    assert (s["cwd"], s["model"], s["started_at"]) == ("/work/b", "m-b", "2026-06-19T10:00:00.000Z")
    assert list(s["stats"].values()) == [200, 70, 100, 20, 1000, 20, 100]
    rows = messages(index, "bbbb")
    assert [m["role"] for m in rows] == ["user", "assistant", "assistant", "assistant", "summary"]
    assert rows[4]["text"] == "Context compacted: 3 prior messages replaced."
    assert rows[1]["stats"] is None and list(rows[3]["stats"].values()) == [-40, 50, 60, 10, 20]
    assert [(c["name"], c["status"]) for c in calls(index, "bbbb")] == [("exec_command", "error"), ("apply_patch", "ok")]


def test_source_b_flat_and_legacy(index, sessions):
    assert sessions["flat-id"]["ended_at"] == "2025-07-19T22:25:43.000Z" and sessions["flat-id"]["stats"] is None
    assert [m["role"] for m in messages(index, "flat-id")] == ["user", "assistant", "assistant"]
    assert calls(index, "old-id")[0]["input_json"] == "not json"
    assert sessions["old-id"]["started_at"] == "2025-04-17T10:00:00Z"


def test_source_c(index, sessions):
    s = sessions["cccc-id"]
    assert (s["cwd"], s["project"], s["model"]) == ("/work/c", "/work/c", "m-c")
    assert list(s["stats"].values()) == [70, 15, 30, 5, None, 70, 100]
    rows = messages(index, "cccc-id")
    kinds = ["user", "wrapped_session", "assistant", "tool", "sub_agent", "sub_agent", "memory", "compaction", "notice", "system", "assistant", "system"]
    assert [m["subtype"] or m["role"] for m in rows] == kinds
    assert rows[5]["related"][0]["title"] == "Look around"
    assert rows[6]["text"] == "Memory: T\n\nGoal: G\n\nNext steps:\n- a\n- b\n\nTags: x\n\nImportance: 0.5"
    assert [(c["name"], c["status"], c["call_index"]) for c in calls(index, "cccc-id")] == [("bash", "ok", 0), ("lost", "error", 0), ("tool_approval", "error", 1)]


def test_missing_roots_and_prefilter(spark, roots, tmp_path):
    assert scan(spark, {"claude": str(tmp_path / "none")}).sessions.count() == 0
    assert scan(spark, roots, containing="RENAME THE long").sessions.count() == 1


def test_saved_index_reads_back(spark, index, tmp_path):
    index.save(str(tmp_path / "i"))
    again = Index.load(spark, str(tmp_path / "i"))
    assert sorted(again.sessions.drop("stats").collect()) == sorted(index.sessions.drop("stats").collect())
    assert again.tool_calls.count() == index.tool_calls.count()
    again.register_views("saved_")
    assert spark.sql("select count(*) from saved_sessions join saved_messages using (file_path)").first()[0] == 26


def test_doctor(spark, roots):
    rows = {r["agent"]: r for r in doctor.doctor(spark, roots).collect()}
    assert rows["codex"]["skipped_compressed"] == 1
    assert rows["codex"]["details"]["format_distribution"] == {"envelope_jsonl": 1, "flat_jsonl": 1, "legacy_json": 1}
    assert rows["codex"]["details"]["first_user_markers"] == {"env_context": 1}
    assert rows["claude"]["details"]["unmatched_tool_uses"] == {"count": 1} and rows["claude"]["empty_sessions"] == 2
    assert rows["eventlog"]["details"]["unknown_event_types"] == {"oddity": 1}
    assert rows["eventlog"]["details"]["schema_versions"] == {"1": 1}
    assert rows["total"]["sessions"] == 7


def test_expand_home():
    assert expand_home("~x") == "~x" and not expand_home("~/x").startswith("~")


def test_stats_cache_coerces(spark, tmp_path):
    path = tmp_path / "cache.json"
    path.write_text('{"version": 2, "totalSessions": "9", "longestSession": 3, "hourCounts": {"9": 4, "10": "x", "11": 7}, "modelUsage": {"m": {"outputTokens": 5, "cacheReadInputTokens": 1}, "n": 4}, "dailyActivity": [1, {"date": "d", "messageCount": 2}]}')
    cache = stats_cache.read(spark, str(path))
    row = cache.first()
    assert (row["version"], row["total_sessions"], row["longest_session"]["session_id"]) == (2, 0, "")
    assert row["hour_counts"] == {"9": 4, "11": 7} and list(row["model_usage"]) == ["m"] and len(row["daily_activity"]) == 1
    assert [r["hour"] for r in stats_cache.busiest_hours(cache).collect()] == ["11", "9"]
    assert stats_cache.models_ranked(cache).first()["model"] == "m"
    assert stats_cache.read(spark, str(tmp_path / "none.json")).isEmpty()
    path.write_text("[1]")
    assert stats_cache.read(spark, str(path)).isEmpty()


def test_paths_with_glob_characters(spark, tmp_path):
    """A folder or file whose name reads like a pattern is taken as it is, and spoils no other."""
    roots = {}
    for agent, made in (("claude", logs.source_a), ("codex", logs.source_b), ("eventlog", logs.source_c)):
        made(tmp_path / "p[1] {a,b} x*y? 50%+z" / agent)
        roots[agent] = str(tmp_path / "p[1] {a,b} x*y? 50%+z" / agent)
    logs.source_a(tmp_path / "p1 a xxy" / "claude")
    found = scan(spark, roots)
    assert {r["session_id"] for r in found.sessions.collect()} == {"aaaa-1", "empty", "garbage", "bbbb", "old-id", "flat-id", "cccc-id"}
    assert found.messages.where("session_id = 'aaaa-1'").count() == 4 and found.messages.where("session_id = 'cccc-id'").count() > 0
    assert scan(spark, roots, containing="rename the long").sessions.count() >= 1
