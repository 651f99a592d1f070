"""Small hand-written logs of the three sources."""

from __future__ import annotations

import json
import pathlib


def write(path: pathlib.Path, lines: list) -> pathlib.Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)) + "\n" for x in lines), encoding="utf-8")
    return path


def source_a(root: pathlib.Path) -> None:
    use = lambda i, name, inp: {"type": "tool_use", "id": i, "name": name, "input": inp}
    result = lambda i, content, bad=False: {"type": "tool_result", "tool_use_id": i, "content": content, "is_error": bad}
    usage = lambda a, b, c, d: {"input_tokens": a, "output_tokens": b, "cache_creation_input_tokens": c, "cache_read_input_tokens": d}
    write(
        root / "-work-demo" / "aaaa-1.jsonl",
        [
            {"type": "mode", "sessionId": "aaaa-1", "timestamp": "2026-06-01T10:00:00.000Z"},
            {"type": "user", "cwd": "/work/demo", "timestamp": "2026-06-01T10:00:01.000Z", "message": {"role": "user", "content": "Rename the long flag"}},
            {"type": "assistant", "timestamp": "2026-06-01T10:01:00.000Z", "message": {"role": "assistant", "model": "m-1", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "Reading"}, use("t1", "Read", {"file_path": "/work/demo/a.py", "z": 1.0})], "usage": usage(4, 100, 50, 60)}},
            {"type": "user", "timestamp": "2026-06-01T10:01:05.000Z", "message": {"role": "user", "content": [result("t1", [{"type": "text", "text": "line one"}, {"type": "text", "text": "line two"}]), {"type": "text", "text": "not shown"}]}},
            {"type": "assistant", "timestamp": "2026-06-01T10:02:00.000Z", "message": {"role": "assistant", "model": "m-2", "content": [{"type": "text", "text": "Testing"}, use("t2", "Bash", {"command": "npm test"}), use("t3", "Edit", {"file_path": "/work/demo/b.py"})], "usage": usage(10, 200, 0, 300)}},
            {"type": "user", "timestamp": "2026-06-01T10:03:00.000Z", "message": {"role": "user", "content": [result("t2", "FAIL 1 test", True)]}},
            {"type": "user", "isMeta": True, "timestamp": "2026-06-01T10:03:01.000Z", "message": {"role": "user", "content": "meta"}},
            "{not json",
            {"type": "system", "subtype": "away_summary", "content": "We fixed half of it", "timestamp": "2026-06-01T11:30:00.000Z"},
        ],
    )
    (root / "-work-demo" / "empty.jsonl").write_bytes(b"")
    write(root / "-work-demo" / "garbage.jsonl", ["nope", "{"])


def source_b(root: pathlib.Path) -> None:
    env = lambda t, kind, payload: {"timestamp": f"2026-06-19T10:00:{t:02d}.000Z", "type": kind, "payload": payload}
    text = lambda role, t: {"type": "message", "role": role, "content": [{"type": "input_text" if role == "user" else "output_text", "text": t}]}
    tokens = lambda total, last: {"type": "token_count", "info": {"total_token_usage": total, "last_token_usage": last, "model_context_window": 1000}}
    use = lambda i, c, o, r: {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "reasoning_output_tokens": r}
    write(
        root / "2026" / "06" / "19" / "rollout-2026-06-19-bbbb.jsonl",
        [
            env(0, "session_meta", {"id": "bbbb", "timestamp": "2026-06-19T09:59:59.000Z", "cwd": "/work/b"}),
            env(1, "turn_context", {"model": "m-b", "cwd": "/else"}),
            env(2, "response_item", text("user", "  <environment_context> x")),
            env(3, "response_item", text("developer", "rules")),
            env(4, "response_item", text("user", "Add a flag")),
            env(5, "response_item", text("assistant", "On it")),
            env(6, "response_item", {"type": "function_call", "name": "exec_command", "call_id": "c1", "arguments": json.dumps({"command": ["bash", "-lc", "npm test"]})}),
            env(7, "response_item", {"type": "function_call_output", "call_id": "c1", "output": json.dumps({"output": "x", "metadata": {"exit_code": 1}})}),
            env(8, "event_msg", tokens(use(100, 40, 30, 10), use(100, 40, 30, 10))),
            env(9, "response_item", {"type": "custom_tool_call", "name": "apply_patch", "call_id": "c2", "status": "completed", "input": "*** Begin Patch\n*** Update File: lib/flags.rs\n*** Add File: lib/words.rs \n"}),
            env(10, "response_item", {"type": "custom_tool_call_output", "call_id": "c2", "output": {"ok": True}}),
            env(11, "event_msg", tokens(use(300, 100, 90, 20), use(20, 60, 60, 10))),
            env(12, "event_msg", {"type": "token_count", "info": None}),
            env(13, "compacted", {"message": "", "replacement_history": [1, 2, 3]}),
        ],
    )
    write(
        root / "rollout-2025-07-19-flat.jsonl",
        [
            {"id": "flat-id", "timestamp": "2025-07-19T22:25:43.000Z", "instructions": None},
            text("user", "Hello"),
            {"type": "local_shell_call", "call_id": "s1", "status": "completed", "action": {"command": ["ls"]}},
            {"type": "function_call_output", "call_id": "s1", "output": "plain"},
            text("assistant", "Done"),
        ],
    )
    (root / "rollout-2025-04-17-old.json").write_text(json.dumps({"session": {"id": "old-id", "timestamp": "2025-04-17T10:00:00Z"}, "items": [text("user", "Hi"), {"type": "function_call", "name": "shell", "call_id": "q", "arguments": "not json"}, 7]}))
    (root / "rollout-x.jsonl.zst").write_bytes(b"zz")


def source_c(root: pathlib.Path) -> None:
    at = lambda n, **kw: {"timestamp": f"2026-06-20T08:{n:02d}:00Z", **kw}
    key = "@vendor/provider-codex-x"
    write(
        root / "cccc.jsonl",
        [
            at(0, type="session_init", id="cccc-id", schemaVersion=1),
            at(1, type="config", config={"model": "m-c"}),
            at(2, type="context", git={"root": "/work/c"}),
            at(3, type="message", message={"role": "user", "content": [{"type": "text", "text": "Run it"}]}),
            at(4, type="message", message={"role": "assistant", "content": [{"type": "text", "text": "Calling"}, {"type": "tool-call", "toolCallId": "k1", "toolName": "bash", "input": {"command": "ls"}}], "providerMetadata": {key: {"threadId": "bbbb", "turnId": "T1", "threadPath": "/p"}}}),
            at(5, type="message", message={"role": "tool", "content": [{"type": "tool-result", "toolCallId": "k1", "toolName": "bash", "output": {"type": "text", "value": "ok"}}]}),
            at(6, type="turn_end", usage={"inputTokens": 100, "outputTokens": 20, "cachedInputTokens": 30, "reasoningTokens": 5}),
            at(7, type="loop_end", usage={"inputTokens": 100, "outputTokens": 20}),
            at(8, type="message", message={"role": "tool", "content": [{"type": "tool-result", "toolCallId": "zz", "toolName": "lost", "output": {"type": "error", "value": "bad"}}, {"type": "tool-approval-response", "approvalId": "a", "approved": False, "reason": "no"}]}),
            at(9, type="sub_agent_started", subAgentId="sub-1", agent="helper", title="Look around", task="see"),
            at(10, type="sub_agent_finished", subAgentId="sub-1", status="done", result="seen"),
            at(11, type="memory", title="T", goal="G", nextSteps=["a", "b"], tags=["x"], importance=0.5),
            at(12, type="compaction", turnCount=3, summary="S"),
            at(13, type="notice", variant="debug", text="hidden"),
            at(14, type="notice", text="seen"),
            at(15, type="cancel"),
            at(16, type="oddity"),
            at(17, type="message", message={"role": "assistant", "content": "Bye", "providerOptions": {key: {"threadId": "bbbb"}}}),
            at(18, type="turn_end", error="boom", usage={"totalTokens": 70}),
        ],
    )
