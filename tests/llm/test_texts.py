import base64
import hashlib
import time
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracefold.llm import bpe, licences, lm_score, quality

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(brute.awkward(["Hello  world's\n\n 12 naïve 日本語", "'s 'll   x", "All rights reserved. CC BY 4.0"]), brute.DOCS)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(codec, reference):
    @settings(max_examples=150, deadline=None)
    @given(st.text(max_size=60))
    def check(text):
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text) and codec.decode(ids) == text.encode()

    check()


def test_perfect_hash():
    keys = [str(i).encode() for i in range(5000)]
    table = bpe.PerfectHash(keys)
    assert [table.get(k) for k in keys] == list(range(5000)) and table.get(b"x") == -1 and bpe.PerfectHash([]).get(b"") == -1


def test_bpe_rows(spark, docs, reference):
    out = bpe.digest(docs.withColumn("t2", F.col("text")), PATH, public_tokenizers.PATTERN, ["doc_id", "t2", "kind"], with_ids=True)
    rows = out.select("t2", "bpe.*").collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = reference.encode_ordinary(r["t2"] or "")
        assert (r["n_tokens"], list(r["ids"])) == (len(ids), ids)
        assert r["ids_sha256"] == brute.sha(" ".join(map(str, ids))) and r["decoded_sha256"] == hashlib.sha256((r["t2"] or "").encode()).hexdigest()
    assert bpe.digest(spark.createDataFrame([], brute.DOCS), PATH, public_tokenizers.PATTERN, ["doc_id"]).count() == 0


def test_bpe_columns_round_trip(docs):
    there = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    back = bpe.decode(there, PATH, public_tokenizers.PATTERN)
    assert back.where("decoded <> cast(coalesce(text, '') as binary)").count() == 0


def plain_licence(text: str | None) -> tuple:
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licences.BASE.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licences(spark, docs):
    texts = ["cc by cc by", "CC-BY, all RIGHTS reserved all rights reserved", "the GNU General Public License v3", "ccby cc\nby", "naïve cc by", "cc by" * 3, "_cc_by_"]
    rows = spark.createDataFrame(brute.awkward(texts), brute.DOCS).withColumn("t2", F.col("text"))
    found = licences.scan(rows).select("t2", "licence.*").collect()
    for r in found:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_licence(r["t2"])
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(","))
    assert licences.scan(spark.createDataFrame([], brute.DOCS)).count() == 0
    assert licences.scan(docs).columns == [*docs.columns, "licence"]


@pytest.mark.parametrize(("expression", "value"), [("MIT", 1.0), ("MIT AND GPL-2.0", 0.4), ("MIT OR GPL-2.0", 1.0), ("GPL-2.0 WITH Classpath-exception-2.0", 0.7), ("(GPL-2.0 OR MIT) AND MPL-2.0", 0.7), ("GPL-2.0 OR MIT AND MPL-2.0", 0.7)])
def test_expressions(expression, value):
    assert licences.evaluate(expression)[0] == pytest.approx(value)


@pytest.mark.parametrize("bad", ["", "AND MIT", "MIT AND", "(MIT", "MIT)", "MIT GPL", "()", "MIT (GPL)"])
def test_malformed_expressions(bad):
    with pytest.raises(ValueError):
        licences.postfix(bad)


def test_tags(spark):
    rows = spark.createDataFrame([(1, "SPDX-License-Identifier: MIT OR Apache-2.0\ncode"), (2, "SPDX-License-Identifier: (MIT"), (3, "Released under the MIT License.")], "doc_id long, text string")
    out = {r["doc_id"]: r["licence"] for r in licences.scan(rows).collect()}
    assert out[1]["labels"] == "apache-2.0,mit" and out[1]["expression"] == "mit apache-2.0 or"
    assert out[2]["labels"] == "" and out[3]["labels"] == "mit"


LINES = {
    "<!-- SPDX-License-Identifier: MIT -->": "mit",
    "SPDX-License-Identifier: MIT-->": "mit",
    "# SPDX-License-Identifier: MIT Copyright 2020 A. B.": "mit",
    "/* SPDX-License-Identifier: GPL-2.0+ OR MIT */": "gpl-2.0+ mit or",
    "Files carry SPDX-License-Identifier: Apache-2.0. And more of this.": "apache-2.0",
    "SPDX-License-Identifier: (MIT OR GPL-2.0) (c) someone": "mit gpl-2.0 or",
    "SPDX-License-Identifier: MIT OR -->": "mit",
    "SPDX-License-Identifier: MIT)": "mit",
    "SPDX-License-Identifier: MIT AND (GPL-2.0": "mit",
    "SPDX-License-Identifier: MIT WITH a WITH b": "mit a with b with",
    "SPDX-License-Identifier: -->": "",
    "SPDX-License-Identifier: (MIT": "",
    "SPDX-License-Identifier: OR MIT": "",
}


def test_tags_with_text_behind(spark):
    rows = spark.createDataFrame(list(LINES.items()), "text string, want string")
    for r in licences.scan(rows).collect():
        assert r["licence"]["expression"] == r["want"], r["text"]
        assert r["want"].split(" ")[0] in r["licence"]["labels"].split(",")


@pytest.mark.parametrize("wide", [1, 48])
def test_field_against_enumeration(monkeypatch, wide):
    """Marginals, likelihood and gradients of sequences, summed over all labelings."""
    from itertools import product

    monkeypatch.setattr(quality, "CELLS", 20)
    monkeypatch.setattr(quality, "WIDE", wide)
    rng = np.random.default_rng(1)
    sizes, moves, w = [1, 4, 2, 6, 3], rng.normal(size=(2, 2)), rng.normal(size=5)
    xs = [rng.normal(size=(n, 5)) for n in sizes]
    y, per = np.array([1.0, 0, 1, 0, 1]), rng.uniform(0.1, 1, 5)

    def energy(s, path):
        return sum(v for v, p in zip(s, path) if p) + sum(moves[a, b] for a, b in zip(path, path[1:]))

    value = -quality.RIDGE / 2 * (w @ w) - quality.RIDGE_MOVES / 2 * (moves**2).sum()
    for x, g, label, weight in zip(xs, quality.marginals([x @ w for x in xs], moves), y, per):
        mass = {p: np.exp(energy(x @ w, p)) for p in product((0, 1), repeat=len(x))}
        z = sum(mass.values())
        assert np.allclose(sum(m * np.array(p) for p, m in mass.items()) / z, g)
        value += weight * np.log(mass[(int(label),) * len(x)] / z)
    stacked, ends = np.vstack(xs), np.cumsum(sizes)
    at = lambda w, m: quality.objective(w, m, stacked, ends, y, per)
    assert at(w, moves)[0] == pytest.approx(value)
    for i in range(5):
        d = np.eye(5)[i] * 1e-5
        assert (at(w + d, moves)[0] - at(w - d, moves)[0]) / 2e-5 == pytest.approx(at(w, moves)[1][i], abs=1e-4)
    for i in range(4):
        d = np.eye(4)[i].reshape(2, 2) * 1e-5
        assert (at(w, moves + d)[0] - at(w, moves - d)[0]) / 2e-5 == pytest.approx(at(w, moves)[2].flat[i], abs=1e-4)


def test_long_labelled_texts_train(spark):
    """Runs cover a text from its first to its last line, and a class of long texts alone is learnt."""
    assert quality.runs_of(5, 5) == [(0, 5)]
    runs = quality.runs_of(10_001, 1024)
    assert len(runs) == 8 and runs[0] == (0, 128) and runs[-1] == (10_001 - 128, 10_001)
    bad, good = "### $$$ 123 @@@ !!!\n" * 5000, "A plain sentence stands here.\nAnother one follows it.\n"
    docs = spark.createDataFrame([(i, bad if i % 2 else good * (i % 5 + 1)) for i in range(60)], "doc_id long, text string")
    field = quality.train(docs, docs.selectExpr("doc_id", "int(1 - doc_id % 2) as quality"))
    assert field.score(bad) < 0.3 < 0.7 < field.score(good)


def test_emissions_are_those_of_the_features():
    lines = ["A line.", "", "### 12", "word word"]
    w = np.random.default_rng(2).normal(size=3 * len(quality.OWN) + 1)
    field = quality.Field(w, np.zeros((2, 2)))
    assert np.allclose(field.emissions(lines), quality.neighbours(quality.own_features(lines)) @ w, atol=1e-5)


def test_licences_of_many_phrases():
    scanner = licences.Scanner()
    took = []
    for n in (50_000, 400_000):
        began = time.time()
        assert scanner.scan("cc by " * n)[:4] == (2 * n, n, 0, 2 * n - 2)
        assert scanner.scan("SPDX-License-Identifier: " + "mit or " * n + "mit")[5] == "mit"
        took.append(time.time() - began)
    assert took[1] < 16 * took[0] + 1


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    field = quality.train(docs, labels)
    scored = quality.score(docs, field).withColumn("held", quality.held_out()).join(labels, "doc_id").where("held").collect()
    assert len(scored) > 30 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in scored)
    assert np.mean([(r["score"] >= quality.THRESHOLD) == r["quality"] for r in scored]) > 0.9


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (7, 3), (0, 1)], "doc_id long, quality int")
    for marks in (labels, labels.where("false"), labels.where("quality = 1")):
        field = quality.train(docs, marks)
        rows = quality.score(docs, field).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(docs.where("false"), field).count() == 0


def plain_losses(texts: list[str], target: list[str]) -> list[tuple]:
    """The two models over the same vocabulary, from dictionaries."""
    from collections import Counter
    from math import log

    split = lambda ts: [t.encode().lower().split() for t in ts]
    sides = {"t": split(target), "b": split(texts)}
    counts = {k: Counter(w for d in v for w in d) for k, v in sides.items()}
    n = {k: sum(c.values()) for k, c in counts.items()}
    words = {w for k in sides for w in counts[k]}
    pairs = {k: Counter(p for d in v for p in zip([b"", *d], d)) for k, v in sides.items()}
    firsts = {k: Counter() for k in sides}
    for k in sides:
        for (p, _), c in pairs[k].items():
            firsts[k][p] += c
    size = len(words) + 1

    def loss(k, before, word):
        single = (counts[k][word] + 0.5) / (n[k] + 0.5 * size)
        return -log((pairs[k][before, word] + lm_score.LEAN * single) / (firsts[k][before] + lm_score.LEAN))

    out = []
    for d in sides["b"]:
        both = [sum(loss(k, a, b) for a, b in zip([b"", *d], d)) / len(d) if d else 0.0 for k in ("t", "b")]
        out.append((len(d), *both))
    return out


@pytest.mark.parametrize(("chunk", "entries"), [(1_000_000, 1_000_000), (7, 5)])
def test_lm_against_dictionaries(spark, monkeypatch, chunk, entries):
    """Every word and pair counts, whatever the chunks and buckets."""
    monkeypatch.setattr(lm_score, "CHUNK", chunk)
    monkeypatch.setattr(lm_score, "ENTRIES", entries)
    texts = [None, "", " \t", "A b x", "a b a c", "a b a c", "c c c c d\x0be", "é É ü", *(f"w{i} often often" for i in range(40))]
    docs = spark.createDataFrame([(None if i < 2 else i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    target = spark.createDataFrame([("a b d",), ("d d b a w1 often",), (None,)], "text string")
    want = plain_losses([t or "" for t in texts], ["a b d", "d d b a w1 often"])
    want = [(None if i < 2 else i // 2, n, round(t, 8), round(b, 8), round(t - b, 8)) for i, (n, t, b) in enumerate(want)]
    got = [(r[0], r[1], *(round(x, 8) for x in r[2:])) for r in lm_score.score(docs, target, ["doc_id"]).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    none = docs.where("false")
    assert lm_score.score(none, target, ["doc_id"]).count() == 0
    assert lm_score.score(docs, target.where("false"), ["doc_id"]).count() == len(texts)
    assert lm_score.score(none, target.where("false"), ["doc_id"]).count() == 0


def test_lm_takes_awkward_rows(spark, docs):
    target = spark.createDataFrame([("word a",)], "text string")
    keep = ["doc_id", "source", "n_chars", "kind", "spans", "__y", "row"]
    assert lm_score.score(docs, target, keep).count() == docs.count()


def test_packing():
    for x in (np.arange(5, dtype=np.int64), np.empty(0, dtype=np.int32), np.array([2**64 - 1, 0], dtype=np.uint64)):
        assert (lm_score.unpack(lm_score.pack(x), x.dtype.type) == x).all()
    a, b = np.array([7, 3, 7, 7], dtype=np.uint64), np.array([9, 1, 2, 9], dtype=np.uint32)
    assert lm_score._sorted(a, b).tolist() == [1, 2, 0, 3]
