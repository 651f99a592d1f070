from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tracefold.functions import text as T
from tracefold.functions import timex
from tracefold.operators import digest, publish, redact

NOW = datetime(2026, 6, 10, 12, tzinfo=timezone.utc)


@pytest.mark.parametrize(
    ("arg", "edge", "want"),
    [("24h", "start", datetime(2026, 6, 9, 12)), ("1.5d", "start", datetime(2026, 6, 9, 0)), ("2w", "start", datetime(2026, 5, 27, 12)), ("1m", "start", datetime(2026, 5, 11, 12)), ("2026-06-01", "start", datetime(2026, 6, 1)), ("2026-06-01", "end", datetime(2026, 6, 1, 23, 59, 59, 999000)), ("2026-06-01T10:00:00Z", "end", datetime(2026, 6, 1, 10)), ("soon", "start", None)],
)
def test_parse_time(arg, edge, want):
    assert timex.parse_time(arg, NOW, edge) == (want and want.replace(tzinfo=timezone.utc))


def one(spark, make, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_text(spark):
    assert one(spark, T.slugify, "Ünï  code!", "--", None) == ["uni-code", "session", "session"]
    assert one(spark, T.json_pretty, '{"a":[1]}', "no json") == ['{\n  "a": [\n    1\n  ]\n}', '"no json"']
    assert one(spark, lambda c: T.cut(c, 3), "abc", "abcd") == ["abc", "abc …[truncated]"]
    assert one(spark, lambda c: T.snippet(c, "X", 5), "abcdeXghijk", "short", "abcdefghij") == ["…deXgh…", "short", "abcd…"]
    assert one(spark, T.first_line, "\r\n  b", " a \nb") == ["b", "a"]
    assert one(spark, T.fence_normalised, "a\n```\nx\n```\nb", "plain") == [publish.fences("a\n```\nx\n```\nb"), "plain"]
    assert one(spark, T.json_quote, 'a"b\n') == ['"a\\"b\\n"']
    assert one(spark, T.is_blank, " \n", "x", None) == [True, False, True]
    assert one(spark, lambda c: T.indent(c, "> "), "a\nb") == ["> a\n> b"]
    assert one(spark, T.summary_label, "recap", "odd") == ["Session Recap", "Summary (odd)"]


@pytest.mark.parametrize(("score", "tier"), [(-2, "trivial"), (2, "trivial"), (3, "light"), (24, "light"), (25, "moderate"), (99, "moderate"), (100, "substantive"), (399, "substantive"), (400, "heavy")])
def test_tiers(spark, score, tier):
    assert spark.range(1).select(digest.tier_of(F.lit(score))).first()[0] == tier


SENSITIVE = "see https://Host.org:443/a?q=1#x and https://h.org me@mail.org SECRET_KEY='a b' PASSWORD=x /Users/ann/p key sk-abcdefghijk conf/.npmrc AB12CD34EF 0123abcd-0123456789abcdef"


@pytest.mark.parametrize("mode", redact.MODES)
def test_redaction_by_columns_and_documents_agree(spark, mode):
    import json

    rows = spark.createDataFrame([(SENSITIVE,), ("",), (None,), ("x" * 2500,)], "output string")
    flat = redact.columns(rows, ["output"], mode, outputs=("output",)).collect()
    docs = rows.select(F.to_json(F.struct("output"), {"ignoreNullFields": "false"}).alias("j"))
    deep = [r["redacted"] for r in redact.documents(docs, "j", mode).collect()]
    for a, b in zip(flat, deep):
        want = json.loads(b["json"])["output"]
        # the documents' way also lowers the host and drops a usual port
        host = "Host.org:443" if mode in ("none", "minimal") else "host.org"
        assert (a["output"] or "").replace("Host.org:443", host) == (want or "")
        assert a["redactions"] == b["counts"]


def test_redaction_modes():
    def kinds(mode, text, path="$.text"):
        r = redact.Redactor(mode)
        return r.walk({"text": text}), [f[0] for f in r.findings]

    assert kinds("none", SENSITIVE)[1] == []
    assert set(kinds("minimal", SENSITIVE)[1]) == {"env_assignment", "secret_like"}
    assert set(kinds("cautious", SENSITIVE)[1]) == {"env_assignment", "secret_like", "email", "url_query", "home_path", "known_auth_file"}
    assert "PASSWORD=x" in kinds("cautious", SENSITIVE)[0]["text"] and "PASSWORD=x" not in kinds("strict", SENSITIVE)[0]["text"]
    assert kinds("cautious", "a/b@c.org")[1] == []
    r = redact.Redactor("strict")
    r.walk({"calls": [{"output": "x " * 600}]})
    assert r.findings == [("long_output_collapsed", "$.calls[0].output", "[OUTPUT_COLLAPSED]")]


def test_child_session():
    assert publish.child_session("agent_run", '{"value": "{\\"subAgentId\\": \\"s\\"}"}') == "s"
    assert publish.child_session("agent_run", '{"subAgentId": "s"}') == "s"
    assert publish.child_session("other", '{"subAgentId": "s"}') is None
    assert publish.child_session("agent_run", "no") is None
