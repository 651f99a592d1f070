"""Command line: ``python -m tracefold.cli list|show|search|extract|redact-check|export-md|doctor|stats``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .model import SOURCE_A, Index
from .plans import commands, pretty, prompts
from .sources.scan import default_roots, scan


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tracefold")
    top.add_argument("--root", action="append", default=[], metavar="AGENT=PATH", help="where a source keeps its logs")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: str, session: str | None = None, query: bool = False):
        p = sub.add_parser(name)
        if session:
            p.add_argument("session", nargs=session if session != "1" else None)
        if query:
            p.add_argument("query")
        for f in ("--agent", *flags):
            p.add_argument(f)
        p.add_argument("--pretty", action="store_true")
        return p

    p = command("list", "--project", "--since", "--until", "--min-importance")
    p.add_argument("--sort", default="recent")
    command("show", session="1")
    command("search", "--project", "--since", "--until", query=True).add_argument("--prefilter", action="store_true")
    command("extract", "--prompt", session="1").add_argument("--full", action="store_true")
    command("redact-check", session="1").add_argument("--redact", default="cautious")
    p = command("export-md", "--title", "--report-out", session="1")
    p.add_argument("--out", required=True)
    p.add_argument("--redact", default="cautious")
    p.add_argument("--yes", action="store_true")
    command("doctor")
    p = command("stats", "--cache", session="?")
    p.add_argument("--global", dest="everything", action="store_true")
    return top


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _json(value) -> str:
    return json.dumps(value, ensure_ascii=False, default=str)


def run(argv: list[str], spark: SparkSession, index: Index | None = None, out=print) -> None:
    a = parser().parse_args(argv)
    roots = default_roots() | dict(r.split("=", 1) for r in a.root)
    if a.command == "doctor":
        rows = _rows(commands.doctor(spark, roots, a.agent))
        return out(pretty.doctor(rows) if a.pretty else _json(rows))
    index = index or scan(spark, roots, a.query if a.command == "search" and a.prefilter else None)
    if a.command == "list":
        rows = _rows(commands.list_sessions(index, a.agent, a.project, a.since, a.until, a.min_importance, a.sort))
        return out(pretty.session_table(rows) if a.pretty else "\n".join(map(_json, rows)))
    if a.command == "search":
        rows = _rows(commands.search(index, a.query, a.agent, a.project, a.since, a.until))
        lines = ({k: v for k, v in r.items() if k != "tool_call" or v is not None} for r in rows)
        return out(pretty.hits(rows) if a.pretty else "\n".join(map(_json, lines)))
    if a.command == "show":
        part = commands.one(index, a.session, a.agent)
        calls: dict[int, list] = {}
        for c in _rows(part.tool_calls.drop("input").orderBy("msg_index", "call_index")):
            calls.setdefault(c["msg_index"], []).append(c)
        messages = [m | {"calls": calls.get(m["msg_index"], [])} for m in _rows(part.messages.orderBy("msg_index"))]
        return out(pretty.transcript(_rows(part.sessions)[0], messages))
    if a.command == "extract":
        row = _rows(commands.extract(index, a.session, a.agent, a.full))[0]
        return out(prompts.prompt(row, a.prompt) if a.prompt else pretty.digest(row) if a.pretty else _json(row))
    if a.command == "redact-check":
        row = _rows(commands.redact_check(index, a.session, a.agent, a.redact))[0]
        return out(pretty.redaction(row["mode"], row["counts"], row["findings"]) if a.pretty else _json(row))
    if a.command == "export-md":
        row = _rows(commands.export_markdown(index, a.session, a.agent, a.title, a.redact, a.yes, report_path=a.report_out))[0]
        _write(a.out, row["markdown"])
        if a.report_out:
            _write(a.report_out, _json({"counts": row["counts"], "findings": row["findings"]}))
        return out(f"Wrote {a.out}")
    if a.session and not a.everything:
        row = _rows(commands.session_stats(index, a.session, a.agent))[0]
        return out(pretty.session_stats(row) if a.pretty else _json(row))
    cache = commands.read_stats_cache(spark, a.cache) if a.cache else commands.read_stats_cache(spark)
    totals, lifetime = commands.global_stats(index, a.agent, cache)
    rows = _rows(totals)
    found = _rows(lifetime)[0] if lifetime is not None and not lifetime.isEmpty() else None
    if not a.pretty:
        return out(_json({"global": found, "session_totals": rows}))
    block = pretty.totals(rows)
    on_disk = next((r["sessions"] for r in rows if r["label"] == SOURCE_A), None)
    return out(pretty.lifetime(found, on_disk, block) if a.agent == SOURCE_A else block)


def _write(path: str, text: str) -> None:
    import pathlib

    where = pathlib.Path(path)
    where.parent.mkdir(parents=True, exist_ok=True)
    where.write_text(text, encoding="utf-8")


def main() -> int:
    spark = SparkSession.builder.appName("tracefold").getOrCreate()
    try:
        run(sys.argv[1:], spark)
    except (ValueError, LookupError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
