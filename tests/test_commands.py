import json

import logs
import pytest

from tracefold import cli
from tracefold.model import Index
from tracefold.operators import publish
from tracefold.operators.filters import Ambiguous, NotFound
from tracefold.plans import commands, prompts
from tracefold.streaming import tail, windows


@pytest.fixture(scope="module")
def top(tmp_path_factory):
    top = tmp_path_factory.mktemp("cmd")
    logs.source_a(top / "a")
    logs.source_b(top / "b")
    logs.source_c(top / "c")
    return top


@pytest.fixture(scope="module")
def index(spark, top):
    found = Index.from_roots(spark, {"claude": str(top / "a"), "codex": str(top / "b"), "eventlog": str(top / "c")})
    return Index(found.sessions.persist(), found.messages.persist(), found.tool_calls.persist())


def run(spark, index, *argv):
    out = []
    cli.run(list(argv), spark, index, out.append)
    return "\n".join(out)


def test_list_sorts_and_filters(index):
    rows = commands.list_sessions(index).collect()
    assert [r["session_id"] for r in rows][:3] == ["cccc-id", "bbbb", "aaaa-1"] and rows[-1]["started_at"] == ""
    best = commands.list_sessions(index, sort="importance").first()
    assert (best["session_id"], best["substance"]["score"], best["substance"]["tier"]) == ("bbbb", 13, "light")
    assert [r["session_id"] for r in commands.list_sessions(index, since="2026-06-19", until="2026-06-19").collect()] == ["bbbb"]
    assert commands.list_sessions(index, min_importance="light").count() == 3
    assert commands.list_sessions(index, agent="gemini").count() == 0
    assert commands.list_sessions(index, project="WORK/B").count() == 1


@pytest.mark.parametrize("bad", [{"agent": "x"}, {"sort": "x"}, {"min_importance": "x"}, {"since": "x"}])
def test_list_rejects(index, bad):
    with pytest.raises(ValueError):
        commands.list_sessions(index, **bad)


def test_resolve(index):
    assert commands.one(index, "aaaa").sessions.count() == 1
    with pytest.raises(NotFound):
        commands.one(index, "zzz")
    with pytest.raises(Ambiguous):
        commands.one(index, "")


def test_search(index):
    hits = commands.search(index, "NPM TEST").collect()
    assert [(h["session_id"], h["tool_call"]) for h in hits] == [("aaaa-1", "Bash"), ("bbbb", "exec_command")]
    assert commands.search(index, "Calling").count() == 0  # a wrapper whose original is here
    assert commands.search(index, "long flag", until="2026-05-01").count() == 0


def test_extract(index):
    d = commands.extract(index, "bbbb", full=True).first().asDict(recursive=True)
    assert d["files"] == {"written": ["lib/flags.rs", "lib/words.rs"], "read": []}
    assert d["tests"] == [{"command": "npm test", "passed": False}]
    assert d["key_turns"] == {"goal": "Add a flag", "final_state": ["On it"]}
    assert len(d["transcript"]) == 5
    assert "Add a flag" in prompts.prompt(d, "handoff") and "Goal" in prompts.prompt(d, "memory")
    with pytest.raises(ValueError):
        prompts.prompt(d, "poem")


def test_stats(index):
    row = commands.session_stats(index, "bbbb").first()
    assert (row["total_tokens"], row["peak_percent"], len(row["per_turn"])) == (390, 10, 2)
    rows = {r["label"]: r for r in commands.global_stats(index)[0].collect()}
    assert rows["total"]["total_input_tokens"] == 84 and rows["wrapped"]["total_input_tokens"] == 200
    assert rows["codex"]["with_stats"] == 0


def test_export(index, spark, top):
    out = top / "page.md"
    run(spark, index, "export-md", "cccc", "--out", str(out), "--report-out", str(top / "r.json"))
    text = out.read_text()
    assert text.startswith("---\ntitle: ") and "Session Memory" in text and "[seen" not in text and text.endswith("\n")
    assert set(json.loads((top / "r.json").read_text())) == {"counts", "findings"}
    with pytest.raises(ValueError):
        commands.export_markdown(index, "cccc", mode="none")


def test_cli_output(spark, index):
    assert json.loads(run(spark, index, "list", "--agent", "codex").splitlines()[0])["session_id"] == "bbbb"
    assert "No matches found." == run(spark, index, "search", "nothing like this", "--pretty")
    assert "--- #1 USER" in run(spark, index, "show", "aaaa")
    assert "Tokens" in run(spark, index, "stats", "bbbb", "--pretty")
    assert "wrapped" in run(spark, index, "stats", "--global", "--pretty")


def test_tail_follows_growth(spark, top, tmp_path):
    root, store = tmp_path / "c", str(tmp_path / "store")
    logs.write(root / "x.jsonl", [{"type": "message", "message": {"role": "user", "content": "one"}}])
    for n in (1, 2):
        tail.follow(spark, "eventlog", str(root), store, str(tmp_path / "ck"), once=True).awaitTermination()
        found = Index.load(spark, store)
        assert (found.sessions.count(), found.messages.count(), found.tool_calls.count()) == (1, n, 0)
        assert found.search("t" if n > 1 else "o").count() == 1
        with (root / "x.jsonl").open("a") as f:
            f.write('{"type": "message", "message": {"role": "user", "content": "two"}}\n')


def test_tail_parses_a_batch_at_once_and_drops_old_rows(spark, top, tmp_path):
    root, store = tmp_path / "c", str(tmp_path / "store")
    said = lambda *texts: [{"type": "message", "message": {"role": "user", "content": t}} for t in texts]
    follow = lambda: tail.follow(spark, "eventlog", str(root), store, str(tmp_path / "ck"), once=True).awaitTermination()
    for i in range(3):
        logs.write(root / f"f{i}.jsonl", said("one", "two"))
    follow()
    assert Index.load(spark, store).messages.count() == 6
    same_size = (root / "f0.jsonl").read_text().replace("two", "six")
    (root / "f0.jsonl").write_text(same_size)
    logs.write(root / "f1.jsonl", [{"type": "nothing"}])
    follow()
    texts = sorted(r["text"] for r in Index.load(spark, store).messages.collect())
    assert texts == ["one", "one", "six", "two"] and Index.load(spark, store).sessions.count() == 3


def test_pages_are_single_files(spark, tmp_path):
    folder = tmp_path / "out [1]"
    folder.mkdir()
    (folder / "own.txt").write_text("stays")
    pages = spark.createDataFrame([("a", "# A\n\ntext\n"), ("b", "# B1"), ("b", "# B2")], "slug string, markdown string")
    for _ in range(2):
        publish.write(pages, str(folder))
    found = {p.name: p.read_text().strip() for p in folder.iterdir() if not p.name.startswith(".")}
    assert found == {"a.md": "# A\n\ntext", "b.md": "# B1", "b--2.md": "# B2", "own.txt": "stays"}


def test_digest_lists_are_capped_before_they_are_gathered(spark):
    said = [("/f", "s", i, i, "summary" if i % 2 else "assistant", "recap" if i % 2 else None, f"t{i}") for i in range(1, 121)]
    messages = spark.createDataFrame(said, "file_path string, session_id string, msg_index int, ord int, role string, subtype string, text string")
    calls = spark.createDataFrame([("/f", 2 * i, j, "Bash" if i % 2 else "Other", "error", f"o{i}.{j}") for i in range(1, 41) for j in range(2)], "file_path string, msg_index int, call_index int, name string, status string, output string")
    full = lambda df, like: Index.empty(spark).__getattribute__(like).unionByName(df, allowMissingColumns=True)
    sessions = full(spark.createDataFrame([("/f", "claude", "s")], "file_path string, agent string, session_id string"), "sessions")
    row = Index(sessions, full(messages, "messages"), full(calls, "tool_calls")).digest().first()
    assert [e["output"] for e in row["errors"]] == [f"o{i}.{j}" for i in range(1, 11) for j in range(2)]
    assert [e["output"] for e in row["failing_commands"]] == [f"o{i}.{j}" for i in range(1, 21, 2) for j in range(2)]
    assert row["final_state"] == ["t116", "t118", "t120"]
    assert [s["text"] for s in row["summaries"]] == [f"t{i}" for i in range(1, 101, 2)]


def test_windows_on_a_stream(spark, index, tmp_path):
    index.messages.where("ts is not null").select("file_path", "ts").write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema("file_path string, ts timestamp").parquet(str(tmp_path / "m"))
    q = windows.activity_windows(stream).writeStream.format("memory").queryName("activity").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = windows.activity_windows(index.messages.where("ts is not null"))
    assert spark.table("activity").count() <= batch.count() == 3
