"""Published bundles: a session, its digest and a manifest; and their Markdown."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SUMMARY_LABELS, first_line, is_blank, slug_key, slugify
from ..functions.timex import iso_millis
from ..model import Index
from ..sources.raw import literal
from . import redact
from .digest import digest
from .related import related_lists

SCHEMA_VERSION, BUNDLE_KIND = 1, "published-session"
SIGNALS = ["message_count", "tool_call_count", "files_written", "files_read", "error_count", "ran_tests", "ended_cleanly", "idle"]


def substance_struct():
    return F.struct("score", "tier", F.struct(*SIGNALS).alias("signals"))


def digest_struct(full: bool = False):
    """The digest of a row of ``digest()`` as one nested value."""
    source = ["agent", "session_id", "file_path", "project", "cwd", "model", "started_at", "ended_at"]
    return F.struct(
        *source, "duration_min", substance_struct().alias("substance"), F.struct("written", "read").alias("files"), "tests",
        F.struct(F.col("command_count").alias("total"), F.col("failing_commands").alias("failing")).alias("commands"), "errors", "tool_usage", "summaries",
        F.struct("goal", "final_state").alias("key_turns"), *(["transcript"] if full else []),
    )


def bundles(index: Index, title: str | None = None, generated_at: str | None = None, mode: str = "none", report_path: str | None = None) -> DataFrame:
    """``(file_path, title, slug, bundle)``, one row a session; ``bundle`` is nested."""
    rows = digest(index, full=True).join(related_lists(index), "file_path", "left")
    rows = rows.withColumn("transcript", F.coalesce("transcript", F.array().cast(rows.schema["transcript"].dataType)))
    rows = rows.withColumn("related_sessions", F.coalesce("related_sessions", F.array().cast(rows.schema["related_sessions"].dataType)))
    named = F.when(~is_blank(F.col("goal")), first_line(F.col("goal"))).otherwise(F.concat(F.lit("Session "), F.col("session_id")))
    rows = rows.withColumn("title", named if title is None else F.lit(title))
    rows = rows.withColumn("slug", slugify(F.coalesce(F.nullif("title", F.lit("")), F.col("session_id"))))
    when = iso_millis(F.current_timestamp()) if generated_at is None else F.lit(generated_at)
    source = F.struct("agent", "session_id", "project", "started_at", "ended_at", "model", "related_sessions")
    manifest = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(BUNDLE_KIND).alias("kind"), "title", "slug", when.alias("generated_at"), source.alias("source"),
        F.struct(F.lit(mode).alias("mode"), F.lit(report_path).cast("string").alias("report_path")).alias("redaction"),
    )
    session = F.struct("agent", "session_id", "file_path", "project", "cwd", "started_at", "ended_at", "model", "message_count", F.col("transcript").alias("messages"), "stats")
    return rows.select("file_path", "session_id", "title", "slug", F.struct(manifest.alias("manifest"), session.alias("session"), digest_struct(full=True).alias("digest")).alias("bundle"))


def redacted(found: DataFrame, mode: str, max_output: int | None = None) -> DataFrame:
    """``bundles()`` with ``redacted``: the redacted bundle as JSON text, counts and findings."""
    return redact.documents(found.withColumn("__json", F.to_json("bundle", {"ignoreNullFields": "false"})), "__json", mode, max_output).drop("__json")


def markdown(found: DataFrame) -> DataFrame:
    """``redacted()`` with a column ``markdown``."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: render(json.loads(t)))

    return found.withColumn("markdown", run(F.col("redacted.json")))


def _safe(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _flat(text: str) -> str:
    return " ".join(text.split())


def _href(session_id: str) -> str:
    return f"../{slug_key(session_id)}/"


def fences(text: str) -> str:
    """Blank lines before an opening and after a closing code fence."""
    lines, out, inside = text.split("\n"), [], False
    for i, line in enumerate(lines):
        if not line.lstrip().startswith(("```", "~~~")):
            out.append(line)
            continue
        if not inside and out and out[-1].strip():
            out.append("")
        out.append(line)
        if inside and i + 1 < len(lines) and lines[i + 1].strip():
            out.append("")
        inside = not inside
    return "\n".join(out)


def render(bundle: dict) -> str:
    """One Markdown document: front matter, title, transcript, summaries, digest, related, source."""
    m, d = bundle["manifest"], bundle["digest"]
    source = m["source"]
    front = {"title": m["title"], "slug": m["slug"], "generatedAt": m["generated_at"], "agent": source["agent"], "sessionId": source["session_id"], "redactionMode": m["redaction"]["mode"]}
    blocks = ["---\n" + "\n".join(f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in front.items()) + "\n---"]
    blocks += [f"# {m['title']}", f"Generated on {m['generated_at']}."]
    blocks += ['<section class="published-transcript" markdown="1">', "## Session Transcript"]
    for message in d["transcript"]:
        blocks += _turn(message, source["model"])
    blocks.append("</section>")
    if d["summaries"]:
        blocks.append("## Summaries")
        for s in d["summaries"]:
            blocks += [f"### {_summary_heading(s)}", *([f"_Timestamp: {s['timestamp']}_"] if s["timestamp"] else []), s["text"]]
    blocks += _digest_blocks(d)
    if source["related_sessions"]:
        blocks += ["## Related Sessions", "\n".join(_related_line(r) for r in source["related_sessions"])]
    about = [("Agent", source["agent"]), ("Session ID", f"`{source['session_id']}`"), ("Project", source["project"] and f"`{source['project']}`"), ("Model", source["model"] and f"`{source['model']}`")]
    about += [("Started", source["started_at"] or "(unknown)"), ("Ended", source["ended_at"]), ("Redaction", m["redaction"]["mode"])]
    blocks += ["## Source", "\n".join(f"- {k}: {v}" for k, v in about if v)]
    return "\n\n".join(blocks).rstrip() + "\n"


def _turn(message: dict, model: str | None) -> list[str]:
    role = message["role"]
    if role == "summary" or (role == "system" and message["subtype"] == "notice"):
        return []
    blocks = []
    if message["text"].strip():
        meta = " · ".join(x for x in (message["timestamp"], model if role == "assistant" else None) if x)
        blocks += [f'<section class="session-turn session-turn-{role}" markdown="1">', f"### {role.capitalize()}"]
        blocks += [f'<p class="turn-timestamp">{_safe(meta)}</p>'] if meta else []
        blocks += [fences(message["text"]), "</section>"]
    if message["tool_calls"]:
        blocks += ['<section class="session-turn session-turn-tools" markdown="1">', "### Tools"]
        for call in message["tool_calls"]:
            blocks += _call(call)
        blocks.append("</section>")
    return blocks


def _call(call: dict) -> list[str]:
    try:
        value = json.loads(call["input"]) if call["input"] is not None else None
    except ValueError:
        value = call["input"]
    blocks = [f"<details>\n<summary>{_safe(call['name'])} - {call['status']}</summary>"]
    child = child_session(call["name"], call["output"])
    if child:
        title = value.get("title") if isinstance(value, dict) and isinstance(value.get("title"), str) else None
        blocks.append(f'<p>Sub-agent session: <a href="{_safe(_href(child))}">{_safe(title or child)} (<code>{_safe(child)}</code>)</a></p>')
    for label, language, text in (("Input:", "json", json.dumps(value, indent=2, ensure_ascii=False)), ("Output:", "text", call["output"])):
        if text:
            blocks.append(f'<p>{label}</p>\n<pre><code class="language-{language}">{_safe(text)}</code></pre>')
    return [*blocks, "</details>"]


def child_session(name: str, output: str | None) -> str | None:
    """The session an ``agent_run`` call started, from its output, which may hold JSON within JSON."""
    if name != "agent_run" or not output:
        return None

    def parsed(text):
        try:
            value = json.loads(text)
        except ValueError:
            return {}
        return value if isinstance(value, dict) else {}

    outer = parsed(output)
    inner = parsed(outer["value"]) if isinstance(outer.get("value"), str) else outer
    found = inner.get("subAgentId")
    return found if isinstance(found, str) else None


def _summary_heading(s: dict) -> str:
    label = SUMMARY_LABELS.get(s["subtype"], f"Summary ({s['subtype']})")
    child = next((r for r in s["related"] or [] if r["kind"] == "sub_agent"), None)
    if child is None:
        return label
    return f"[{'Sub-Agent Session: ' + child['title'] if child['title'] else label}]({_href(child['session_id'])})"


def _related_line(r: dict) -> str:
    label = f"{r['title']} (`{r['session_id']}`)" if r["title"] else f"`{r['session_id']}`"
    parts = [f"{r['agent']} {r['kind']}: [{label}]({_href(r['session_id'])})", r["turn_id"] and f"turn `{r['turn_id']}`", r["path"] and f"path `{r['path']}`"]
    return "- " + "; ".join(p for p in parts if p)


def _digest_blocks(d: dict) -> list[str]:
    s, keys = d["substance"], d["key_turns"]
    facts = [f"Substance: {s['tier']} (score {s['score']})", f"Tool calls: {s['signals']['tool_call_count']}", f"Files written: {len(d['files']['written'])}", f"Files read: {len(d['files']['read'])}", f"Errors: {len(d['errors'])}", f"Tests run: {len(d['tests'])}"]
    if d["duration_min"] is not None:
        facts.append(f"Duration: {int(d['duration_min'] + 0.5)} min")
    verdict = {None: "unknown", True: "pass", False: "fail"}
    lists = [
        ("### Final State", [_flat(t) for t in keys["final_state"]]),
        ("### Files Written", [f"`{p}`" for p in d["files"]["written"]]),
        ("### Files Read", [f"`{p}`" for p in d["files"]["read"]]),
        ("### Tests", [f"[{verdict[t['passed']]}] `{t['command']}`" for t in d["tests"]]),
        ("### Errors", [e["name"] + (f": {_flat(e['output'])}" if e["output"] else "") for e in d["errors"]]),
    ]
    blocks = ["## Digest", "\n".join(f"- {f}" for f in facts)]
    blocks += ["### Goal", keys["goal"]] if keys["goal"] else []
    for title, items in lists:
        blocks += [title, "\n".join(f"- {i}" for i in items)] if items else []
    return blocks


def archive(pages: DataFrame) -> DataFrame:
    """Published pages (``session_id``, ``generated_at``, ``path``) below ``sessions/``, the newest first."""
    return pages.where(F.contains("path", F.lit("sessions/"))).orderBy(F.desc("generated_at"), "session_id")


def write(found: DataFrame, folder: str) -> None:
    """One ``.md`` file a page, named by its slug; the folder's other files stay.

    Executors write the texts, the driver only renames files. Pages of equal slugs are told
    apart by ``--`` and a number, which no slug holds.
    """
    spark = found.sparkSession
    nth = F.row_number().over(Window.partitionBy("slug").orderBy("markdown"))
    pages = found.select(F.concat("slug", F.when(nth > 1, F.concat(F.lit("--"), nth)).otherwise("")).alias("page"), F.col("markdown").alias("value"))
    scratch = f"{folder.rstrip('/')}/_pages-{uuid.uuid4().hex}"
    pages.write.partitionBy("page").option("lineSep", "\n").text(scratch)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(scratch).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for state in fs.globStatus(path(f"{literal(scratch)}/page=*/part-*")) or []:
        page = path(folder, state.getPath().getParent().getName()[len("page=") :] + ".md")
        fs.delete(page, False)
        fs.rename(state.getPath(), page)
    fs.delete(path(scratch), True)
