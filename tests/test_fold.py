"""The Spark fold of source A against a plain fold of random logs."""

import json
import random

import logs
import pytest

from tracefold.model import Index


def random_log(seed: int) -> list:
    rng = random.Random(seed)
    ids, out = [f"t{i}" for i in range(4)], []
    stamp = lambda: rng.choice([None, "", f"2026-06-0{rng.randint(1, 9)}T0{rng.randint(0, 9)}:00:00Z"])
    for _ in range(rng.randint(0, 25)):
        line = {"timestamp": stamp(), "cwd": rng.choice([None, "", "/a", "/b"]), "sessionId": rng.choice([None, "", "s1", "s2"])}
        line = {k: v for k, v in line.items() if v is not None}
        kind = rng.randrange(7)
        if kind == 0:
            line["message"] = {"role": "user", "content": rng.choice(["hi", "", "two\nlines"])}
            line["isMeta"] = rng.random() < 0.3
        elif kind < 4:
            blocks = [rng.choice([{"type": "text", "text": "said"}, {"type": "thinking", "thinking": "x"}, {"type": "text", "text": 5}, {"type": "tool_use", "id": rng.choice(ids), "name": "Bash", "input": {"command": "ls"}}]) for _ in range(rng.randrange(4))]
            line["message"] = {"role": "assistant", "model": rng.choice(["m1", "m2"]), "content": blocks, "usage": {"input_tokens": rng.randrange(3), "output_tokens": rng.choice([0, 2, "9", -4]), "cache_read_input_tokens": rng.randrange(2)}}
        elif kind < 6:
            content = rng.choice(["plain", None, [{"type": "text", "text": "a"}, {"type": "text"}]])
            blocks = [{"type": "tool_result", "tool_use_id": rng.choice(ids), "content": content, "is_error": rng.random() < 0.4} for _ in range(rng.randrange(3))] + [{"type": "text", "text": "t"}] * rng.randrange(2)
            line["message"] = {"role": "user", "content": blocks}
        else:
            line |= {"type": "system", "subtype": "away_summary", "content": rng.choice(["", "recap"])}
        out.append(line)
    return out


def number(x) -> int:
    return x if isinstance(x, int) and x >= 0 else 0


def plain_fold(stem: str, lines: list) -> dict:
    s = {"session_id": stem, "cwd": None, "model": None, "started_at": "", "ended_at": None}
    messages, open_calls, sums, contexts = [], {}, [0, 0, 0], []
    for line in lines:
        s["session_id"] = line.get("sessionId") or s["session_id"]
        s["cwd"] = line.get("cwd") or s["cwd"]
        if line.get("timestamp"):
            s["started_at"] = s["started_at"] or line["timestamp"]
            s["ended_at"] = line["timestamp"]
        m = line.get("message") or {}
        content = m.get("content")
        texts = [b["text"] for b in content if b["type"] == "text" and isinstance(b.get("text"), str)] if isinstance(content, list) else []
        if m.get("role") == "assistant":
            s["model"] = m["model"]
            calls = [[b["name"], "unknown", None] for b in content if b["type"] == "tool_use"]
            for b, c in zip([b for b in content if b["type"] == "tool_use"], calls):
                open_calls[b["id"]] = c
            messages.append(("assistant", "\n".join(texts), calls))
            u = [number(m["usage"].get(k)) for k in ("input_tokens", "output_tokens", "cache_read_input_tokens")]
            if any(u):
                sums = [a + b for a, b in zip(sums, u)]
                contexts += [u[0] + u[2]] if u[0] + u[2] else []
        elif m.get("role") == "user" and isinstance(content, str):
            if not line["isMeta"]:
                messages.append(("user", content, []))
        elif m.get("role") == "user":
            results = [b for b in content if b["type"] == "tool_result"]
            for b in results:
                if b["tool_use_id"] in open_calls:
                    c = b["content"]
                    open_calls[b["tool_use_id"]][1:] = ["error" if b["is_error"] else "ok", c if isinstance(c, str) else "\n".join(x.get("text") or "" for x in c or [])]
            if texts and not results:
                messages.append(("user", "\n".join(texts), []))
        if line.get("subtype") == "away_summary" and line["content"]:
            messages.append(("summary", line["content"], []))
    s["stats"] = [*sums, 0, None, contexts[-1] if contexts else None, max(contexts, default=None)] if any(sums) else None
    return s | {"messages": [(r, t, [tuple(c) for c in cs]) for r, t, cs in messages]}


@pytest.fixture(scope="module")
def folded(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("random")
    for i in range(60):
        logs.write(root / "p" / f"f{i:02d}.jsonl", [json.dumps(x) for x in random_log(i)] + ["{broken"])
    index = Index.from_roots(spark, {"claude": str(root)})
    calls = {}
    for c in index.tool_calls.orderBy("file_path", "msg_index", "call_index").select("file_path", "msg_index", "name", "status", "output").collect():
        calls.setdefault((c["file_path"], c["msg_index"]), []).append((c["name"], c["status"], c["output"]))
    messages = {}
    for m in index.messages.orderBy("file_path", "msg_index").collect():
        messages.setdefault(m["file_path"], []).append((m["role"], m["text"], calls.get((m["file_path"], m["msg_index"]), [])))
    return {r["file_path"][-9:-6]: (r, messages.get(r["file_path"], [])) for r in index.sessions.collect()}


def test_random_logs(folded):
    assert len(folded) == 60
    for i in range(60):
        want = plain_fold(f"f{i:02d}", random_log(i))
        row, messages = folded[f"f{i:02d}"]
        for k in ("session_id", "cwd", "model", "started_at", "ended_at"):
            assert row[k] == want[k], (i, k)
        assert (None if row["stats"] is None else list(row["stats"])) == want["stats"], i
        assert messages == want["messages"], i
