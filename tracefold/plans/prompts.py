"""Prompts around a digest, for a language model to continue from or remember."""

from __future__ import annotations

import json

KINDS = ["handoff", "memory"]


def _short(text: str, most: int) -> str:
    return text if len(text) <= most else text[: most - 1] + "…"


def _listed(items: list[str]) -> str:
    return "\n".join(f"  - {i}" for i in items) or "  (none)"


def prompt(digest: dict, kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"invalid prompt {kind!r}; one of {', '.join(KINDS)}")
    s, keys = digest["substance"], digest["key_turns"]
    signals = s["signals"]
    task = {
        "handoff": "Another agent takes over the session below. Write it a short handoff: what was wanted, what is done, where things stand, what remains.",
        "memory": "Write two to four sentences worth remembering about the session below, its outcome, and files or decisions that matter. Close with how important it is: trivial, light, moderate, substantive or heavy.",
    }[kind]
    minutes = digest["duration_min"]
    parts = [
        task,
        f"Session {digest['session_id']} of {digest['agent']}, project {digest['project'] or '-'}, model {digest['model'] or '-'}, started {digest['started_at']}, lasted {'-' if minutes is None else f'{round(minutes)} min'}.",
        f"Substance {s['tier']} (score {s['score']}): {signals['tool_call_count']} tool calls, {signals['files_written']} files written, {signals['error_count']} errors, tests {'run' if signals['ran_tests'] else 'not run'}, {'ended cleanly' if signals['ended_cleanly'] else 'interrupted'}.",
        "Files written:\n" + _listed(digest["files"]["written"]),
    ]
    if kind == "handoff":
        parts.append("Errors:\n" + _listed([e["name"] + (": " + _short(e["output"], 160) if e["output"] else "") for e in digest["errors"]]))
    parts += [
        "Summaries and provenance:\n" + _listed([f"[{x['subtype']}] {_short(x['text'], 400)}" for x in digest["summaries"]]),
        "Goal:\n" + (keys["goal"] or "(none)"),
        "Final state:\n" + _listed([_short(t, 400) for t in keys["final_state"]]),
        "Digest as JSON:\n" + json.dumps(digest, indent=2, ensure_ascii=False, default=str),
    ]
    return "\n\n".join(parts) + "\n"
