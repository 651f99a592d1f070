"""Aligned text for terminals; each takes rows of an already small result."""

from __future__ import annotations

from collections.abc import Iterable


def _cut(text: str, most: int) -> str:
    return text if len(text) <= most else text[: most - 1] + "…"


def _n(value: int) -> str:
    return f"{value:,}"


def _plural(n: int, word: str) -> str:
    return f"{n} {word}{'' if n == 1 else 's' if not word.endswith('ch') else 'es'}"


def session_table(rows: Iterable[dict]) -> str:
    rows = list(rows)
    if not rows:
        return "No sessions found."
    heads = ["agent", "sessionId", "startedAt", "msgs", "tier", "model", "project"]
    cells = [[r["agent"], r["session_id"][:12], r["started_at"][:19] or "(unknown)", str(r["message_count"]), r["substance"]["tier"], r["model"] or "-", r["project"] or "-"] for r in rows]
    widths = [max(len(h), *(len(c[i]) for c in cells)) for i, h in enumerate(heads)]
    line = lambda xs: "  ".join(x.ljust(w) for x, w in zip(xs, widths))
    return "\n".join([line(heads), "-" * len(line(heads)), *map(line, cells), "", _plural(len(rows), "session")])


def hits(rows: Iterable[dict]) -> str:
    rows = list(rows)
    if not rows:
        return "No matches found."
    out = []
    for r in rows:
        tool = f" · {r['tool_call']}" if r["tool_call"] else ""
        out += [f"[{r['agent']}] {r['session_id'][:12]}  #{r['message_index']}  {r['role']}{tool}", "  " + _cut(" ".join(r["text"].split()), 120)]
    return "\n".join([*out, "", _plural(len(rows), "match")])


def transcript(session: dict, messages: Iterable[dict]) -> str:
    """``messages`` as dicts of a message with ``calls``, in order."""
    head = [("Session", session["session_id"]), ("Agent", session["agent"]), ("Project", session["project"]), ("Cwd", session["cwd"]), ("Model", session["model"]), ("Started", session["started_at"] or "(unknown)"), ("Ended", session["ended_at"]), ("Messages", str(session["message_count"]))]
    out = [f"{k + ':':<9} {v}" for k, v in head if v] + [""]
    icon = {"ok": "✓", "error": "✗"}
    for m in messages:
        out.append(f"--- #{m['msg_index']} {m['role'].upper()}{f' [{m['timestamp']}]' if m['timestamp'] else ''} ---")
        out += [m["text"]] if m["text"] else []
        for c in m["calls"]:
            out.append(f"  {icon.get(c['status'], '?')} {c['name']}")
            out += [f"    in:  {_cut(c['input_json'], 200)}"] if c["input_json"] else []
            out += [f"    out: {_cut(c['output'], 300)}"] if c["output"] else []
        out.append("")
    return "\n".join(out)


def digest(d: dict) -> str:
    s, keys, files = d["substance"], d["key_turns"], d["files"]
    g = s["signals"]
    out = [f"Session:   {d['session_id']}", f"Agent:     {d['agent']}", f"Substance: {s['tier']} (score {s['score']})"]
    out.append(f"Signals:   {g['tool_call_count']} calls, {g['files_written']} written, {g['files_read']} read, {g['error_count']} errors" + (", idle" if g["idle"] else ""))
    if d["duration_min"] is not None:
        out.append(f"Duration:  {round(d['duration_min'])} min")

    def section(title: str, items: list[str], most: int | None = None) -> None:
        if items:
            shown = items if most is None else items[:most]
            out.extend(["", title, *(f"  {i}" for i in shown)])
            if len(items) > len(shown):
                out.append(f"  … and {len(items) - len(shown)} more")

    section("Goal", [_cut(keys["goal"], 600)] if keys["goal"] else [])
    section("Files written", files["written"])
    section("Files read", files["read"], 20)
    section("Tests", [f"[{ {None: '?', True: 'pass', False: 'fail'}[t['passed']] }] {t['command']}" for t in d["tests"]])
    section("Errors", [e["name"] + (": " + _cut(e["output"], 100) if e["output"] else "") for e in d["errors"]], 10)
    section("Tools", [f"{t['name']} × {t['count']}" for t in d["tool_usage"]], 10)
    section("Summaries", [f"[{x['subtype']}] {_cut(x['text'], 600)}" for x in d["summaries"]])
    section("Final state", [_cut(t, 600) for t in keys["final_state"]])
    return "\n".join(out)


def redaction(mode: str, counts: dict, findings: list[dict]) -> str:
    out = [f"Redaction mode: {mode}", *(f"  {k:<22} {n}" for k, n in counts.items())]
    if findings:
        out += ["", "Sample findings", *(f"  {f['kind']} at {f['path']} -> {f['replacement']}" for f in findings[:20])]
        out += [f"  … and {len(findings) - 20} more"] * (len(findings) > 20)
    return "\n".join(out)


def doctor(rows: Iterable[dict]) -> str:
    out = []
    for r in rows:
        out.append(f"{r['agent']}: {r['sessions']} sessions in {r['files']} files, {r['empty_sessions']} empty" + (f", {r['skipped_compressed']} compressed files skipped" if r["skipped_compressed"] else ""))
        for name, counts in sorted(r["details"].items()):
            drift = name.startswith("un") and sum(counts.values())
            out.append(f"  {'⚠ ' if drift else ''}{name}: " + (", ".join(f"{k} {n}" for k, n in sorted(counts.items())) or "none"))
    return "\n".join(out)


def session_stats(r: dict) -> str:
    out = [f"Session:  {r['session_id']}", f"Agent:    {r['agent']}"]
    out += [f"Project:  {r['project']}"] if r["project"] else []
    out += [f"Model:    {r['model']}"] if r["model"] else []
    out += [f"Started:  {r['started_at'] or '(unknown)'}", f"Messages: {r['message_count']}", ""]
    s = r["stats"]
    if s is None:
        return "\n".join([*out, "No token usage recorded for this session."])
    out += ["Tokens", f"  input   {_n(s['total_input_tokens'])} (cached: {_n(s['cached_input_tokens'])})", f"  output  {_n(s['total_output_tokens'])} (reasoning: {_n(s['reasoning_tokens'])})", f"  total   {_n(r['total_tokens'])}", ""]
    sizes = [("limit", s["context_window"], None), ("peak", s["peak_context_size"], r["peak_percent"]), ("final", s["final_context_size"], r["final_percent"])]
    if any(v is not None for _, v, _ in sizes):
        out += ["Context window", *(f"  {k:<6} {_n(v)}" + (f" ({p}%)" if p is not None else "") for k, v, p in sizes if v is not None), ""]
    if r["per_turn"]:
        out.append("Per turn")
        for t in r["per_turn"]:
            c, w = t["stats"]["context_size"], s["context_window"]
            share = f" ({int(100 * c / w + 0.5)}%)" if c is not None and w else ""
            out.append(f"  #{t['turn']:>2}  in {_n(t['stats']['input_tokens'])}  out {_n(t['stats']['output_tokens'])}  ctx {'-' if c is None else _n(c)}{share}")
    return "\n".join(out)


def totals(rows: Iterable[dict]) -> str:
    """Rows by agent that have usage; a wrapped row is nested and no addend; a total only over several."""
    rows = {r["label"]: r for r in rows}
    total, wrapped = rows.pop("total"), rows.pop("wrapped")
    if not total["with_stats"]:
        return ""
    shown = [(k, r) for k, r in rows.items() if r["with_stats"]]
    several = len(shown) > 1
    if wrapped["with_stats"]:
        shown.append(("  └ wrapped", wrapped))
    if several:
        shown.append(("total", total))
    cells = [[k, f"{_n(r['with_stats'])} sess", f"in {_n(r['total_input_tokens'])}", f"out {_n(r['total_output_tokens'])}"] for k, r in shown]
    widths = [max(len(c[i]) for c in cells) for i in range(4)]
    lines = ["  " + "   ".join([c[0].ljust(widths[0]), *(x.rjust(w) for x, w in zip(c[1:], widths[1:]))]) for c in cells]
    return "\n".join(["Per-session totals", *lines, f"  cached {_n(total['cached_input_tokens'])}   reasoning {_n(total['reasoning_tokens'])}"])


def duration(ms: int) -> str:
    minutes = int(ms / 60_000 + 0.5)
    if minutes < 60:
        return f"{minutes} min"
    hours = minutes // 60
    return f"{hours}h {minutes % 60}m" if hours < 24 else f"{hours // 24}d {hours % 24}h"


def lifetime(cache: dict | None, on_disk: int | None, block: str) -> str:
    """The lifetime cache around the block of transcript totals."""
    if cache is None:
        return "Stats cache not found; transcript totals only.\n\n" + block
    longest = cache["longest_session"]
    out = [f"All time (since {cache['first_session_date'] or '(unknown)'})", f"  sessions  {_n(cache['total_sessions'])}" + (f"   ({_n(on_disk)} transcripts on disk)" if on_disk is not None else ""), f"  messages  {_n(cache['total_messages'])}"]
    if longest["session_id"]:
        out.append(f"  longest   {_n(longest['message_count'])} msgs ({duration(longest['duration'])})  {longest['session_id']}")
    models = sorted(cache["model_usage"].items(), key=lambda m: -(m[1]["outputTokens"] + m[1]["cacheReadInputTokens"]))
    if models:
        out += ["", "Tokens by model"]
        for name, u in models:
            out += [f"  {name}", f"    in {_n(u['inputTokens'])}   out {_n(u['outputTokens'])}   cache-read {_n(u['cacheReadInputTokens'])}   cache-create {_n(u['cacheCreationInputTokens'])}"]
    out += ["", block]
    hours = sorted(cache["hour_counts"].items(), key=lambda h: -h[1])[:5]
    if hours:
        out += ["", "Busiest hours", *(f"  {h.zfill(2)}:00  {_n(n)}" for h, n in hours)]
    return "\n".join(out)
