"""The redaction queries over whole texts, against the same rules applied one by one in Python."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracefold.operators import redact
from tracefold.plans.queries import QUERIES

TEXTS = [
    None,
    "",
    "write to some.one@example.org or x@y.de, not @z",
    "id " + "0a" * 20 + " and " + "Zz9+" * 12 + " end",
    "long " * 700,
    "TOKEN_A=1 /home/me/x\n/Users/you see a/.env AB12CD34EF https://u:p@h.org/a?q=1 sk-abcdefgh1",
    "emoji \U0001f600 " * 120 + "last@example.org",
]
def md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


LITERALS = {
    "redact_email": ("cautious", "email", None),
    "redact_hex_strict": ("strict", "secret_like", lambda i: f" id {md5(str(i))}{md5(f'x{i}')} end"),
    "redact_collapse": ("strict", "long_output_collapsed", None),
    "redact_env_cautious": ("cautious", "env_assignment", lambda i: f" a SECRET_TOKEN=abc{i} PASSWORD=x b FOO=1"),
    "redact_env_strict": ("strict", "env_assignment", lambda i: f' a SECRET_TOKEN=abc{i} PASSWORD="x y" b FOO=1'),
    "redact_tokens": ("minimal", "secret_like", lambda i: f" x sk-abcdefgh{i} ghp_abcdefgh{i}, glpat-abcdefgh pat_abcd.efgh eyJa{i}.b-c.d_e sk-short"),
    "redact_ten_char": ("cautious", "secret_like", lambda i: f" dev AB12CD34E{'' if i % 2 else 'F'}, ABCDEFGHIJ 1234567890"),
    "redact_home": ("cautious", "home_path", lambda i: f" at /Users/u{i}/x, not /homes/a or /home/a, but /home/v{i}"),
    "redact_authfile": ("cautious", "known_auth_file", lambda i: f" see conf/.npmrc and a{i}.pem"),
    "redact_team_id": ("cautious", "secret_like", lambda i: f" the team ID is `AB{i:08d}` ok"),
}


def plain(text: str, mode: str, cut: bool = False) -> tuple[str, Counter]:
    found = Counter()
    if cut and len(text) > 1000:
        text, found["long_output_collapsed"] = f"{text[:1000]}\n[... output collapsed; {len(text) - 1000} chars omitted ...]", 1
    for r in redact.RULES:
        if mode in r.modes:
            text, n = re.subn(r.pattern, re.sub(r"\$(\d)", r"\\g<\1>", r.replacement), text, flags=re.ASCII)
            found[r.kind] += n
    return text, found


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("texts"))
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    own = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    real.withColumn("doc_id", F.col("doc_id").cast("long")).unionByName(own).write.parquet(f"{d}/documents.parquet")
    return d, {r["doc_id"]: r["text"] or "" for r in real.collect()} | {10**6 + i: t or "" for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("name", sorted(LITERALS))
def test_whole_texts(spark, documents, name):
    d, texts = documents
    mode, kind, literal = LITERALS[name]
    want = {}
    for i, t in texts.items():
        text, found = plain(f"{t}{literal(i)}" if literal else t, mode, "collapse" in name)
        want[i] = text, found[kind]
    got = {r["doc_id"]: (r["text"], r["n"]) for r in QUERIES[name](spark, d).collect()}
    assert got == want and sum(n for _, n in got.values()) > 0


def test_whole_counts(spark, documents):
    d, texts = documents
    want = Counter()
    for i, t in texts.items():
        want += plain(f"{t} API_KEY=v{i} sk-abcdefghij me@example.com https://h.org/p?q=1 /home/me/x a/.npmrc", "cautious")[1]
    got = {r["kind"]: r["n"] for r in QUERIES["redact_counts_by_kind"](spark, d).collect()}
    assert +Counter(got) == want and set(got) == set(redact.KINDS)
