import math
from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from tracefold.llm import mixing
from tracefold.llm._common import ROW, row_key


def rows():
    sizes = {"a": 300, "b": 40, "c": 12, None: 25}
    out, i = [], 0
    for s, n in sizes.items():
        for k in range(n):
            out.append((i, "w " * (k % 7 + 1), s, 1, 2))
            i += 1
    return [*out, (i, "", "a", 1, 2), (i + 1, None, "d", 1, 2), (i + 1, "x y", "b", 1, 2), (i + 1, "x y", "b", 1, 2), (None, "z", "c", 1, 2)]


SCHEMA = "doc_id long, text string, source string, tokens int, p int"


def weights(totals: dict, a: float) -> dict:
    t = sum(totals.values())
    z = sum((n / t) ** a for n in totals.values())
    return {s: (n / t) ** a / z for s, n in totals.items()}


def plain_exponent(totals: dict, met) -> float:
    if met(weights(totals, 0.0)):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if met(weights(totals, mid)) else (mid, high)
    return high


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.mark.parametrize("target", [{"repeats": 1.4}, {"repeats": 9.0}, {"repeats": 1.0}, {"entropy": 0.8}, {"entropy": 0.2}])
def test_plan(docs, target):
    totals = defaultdict(int)
    for _, text, source, *_ in rows():
        totals[source] += len((text or "").split())
    totals = {s: n for s, n in totals.items() if n}
    t = sum(totals.values())
    most = math.log(len(totals))
    met = {"repeats": lambda w: max(w[s] * t / totals[s] for s in w) <= target.get("repeats", 0), "entropy": lambda w: -sum(x * math.log(x) for x in w.values()) <= target.get("entropy", 0) * most}[next(iter(target))]
    want = weights(totals, plain_exponent(totals, met))
    got = mixing.plan(docs, **target).collect()
    assert len(got) == docs.count() and "text" not in got[0].asDict()
    used, longest = defaultdict(int), 7
    for r in got:
        if r["source"] in want:
            assert r["weight"] == pytest.approx(want[r["source"]], abs=1e-6)
            assert r["copies"] in (math.floor(want[r["source"]] * t / totals[r["source"]] + 1e-6), math.floor(want[r["source"]] * t / totals[r["source"]] + 1e-6) + 1)
        used[r["source"]] += r["copies"] * r["n_tokens"]
    for s in want:
        assert want[s] * t - longest - 1e-3 <= used[s] <= want[s] * t + 1e-3


def test_order_is_a_permutation_by_blocks(docs, monkeypatch):
    whole = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.plan(docs, repeats=1.3).where("doc_id is not null").collect()}
    again = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.plan(docs.repartition(3), repeats=1.3).where("doc_id is not null").collect()}
    assert whole == again
    other = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.plan(docs, repeats=1.3, seed=1).where("doc_id is not null").collect()}
    assert whole != other
    monkeypatch.setattr(mixing, "BLOCK", 8)
    small = mixing.plan(docs, repeats=1.3)
    a, b = (x.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n")) for x in (small, mixing.plan(docs, repeats=1.3)))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def plain_copies(docs, weight: dict, budget: float, floor: int, seed: int = 42) -> dict:
    """Copies of all rows of each kind, by one walk over each source in hash order."""
    keyed = docs.select("*", *row_key(docs)).withColumn("h", F.xxhash64(F.lit(seed), *ROW)).collect()
    kinds = defaultdict(list)
    for r in keyed:
        kinds[r["source"], (r["h"], r["row1"], r["row2"])].append(r)
    blocks = -(-len(kinds) // mixing.BLOCK)
    tokens = defaultdict(int)
    for r in keyed:
        tokens[r["source"]] += len((r["text"] or "").split())
    out = {}
    for source, n in tokens.items():
        due = weight.get(source, 0) * budget * sum(tokens.values()) + 1e-6
        passes = max(floor, math.floor(due / n)) if n else 1
        rest, at = due - passes * n if n else -1, 0
        for _, key in sorted(((k[0] % blocks, k) for s, k in kinds if s == source)):
            rows = kinds[source, key]
            size = len((rows[0]["text"] or "").split())
            taken = 0
            for _ in rows:
                taken += at + size <= rest
                at += size
            out[tuple(map(str, rows[0][:-3]))] = passes * len(rows) + taken
    return out


def found_copies(docs, out) -> dict:
    got = defaultdict(int)
    names = [c for c in docs.columns if c != "text"]
    for r in out.collect():
        got[tuple(str(r[c]) for c in names)] += r["copies"]
    return dict(got)


@pytest.mark.parametrize("block", [512, 7])
def test_copies_against_a_plain_walk(docs, block, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", block)
    numbered = docs.withColumn("text", F.col("text")).withColumn("size", F.length("text"))
    out = mixing.plan(numbered, repeats=1.4)
    weight = {r["source"]: r["weight"] for r in out.where("n_tokens > 0").collect()}
    want = defaultdict(int)
    for key, n in plain_copies(numbered, weight, 1.0, 0).items():
        want[tuple(x for c, x in zip(numbered.columns, key) if c != "text")] += n
    assert found_copies(numbered, out) == want


def test_null_and_repeated_ids_give_the_same_copies_anywhere(spark, docs):
    more = docs.unionByName(docs.where("source = 'a'").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.where("source = 'b'").withColumn("doc_id", F.lit(3).cast("long")).withColumn("text", F.concat("text", F.lit("v"))))
    seen = set()
    for n in (1, 3, 8):
        again = mixing.realise(more.repartition(n), repeats=1.3).groupBy(*docs.columns).count().collect()
        seen.add(str(sorted(map(str, again))))
    assert len(seen) == 1


def test_no_task_holds_more_than_a_block(spark, monkeypatch):
    """Rows without ids of their own, a third of them wholly alike."""
    monkeypatch.setattr(mixing, "BLOCK", 20)
    held, real = [], mixing.saved

    def seen(df):
        out = real(df)
        if "m" in df.columns and "h" in df.columns:
            held.append(out)
        return out

    monkeypatch.setattr(mixing, "saved", seen)
    alike = spark.createDataFrame([(None if i % 2 else 7, f"w{i}", "a", 1, 2) for i in range(400)] + [(None, "x", "a", 1, 2)] * 200, SCHEMA)
    out = mixing.plan(alike, repeats=2.0)
    assert out.count() == 600 and {r["copies"] for r in out.collect()} == {1}
    blocks = -(-401 // 20)
    sizes = held[0].groupBy(F.pmod("h", F.lit(blocks))).count().collect()
    assert held[0].count() == 401 and len(sizes) > 10 and max(r["count"] for r in sizes) <= 60


def test_any_columns(spark, docs):
    names = ["weight", "start", "passes", "rest", "b", "own", "n", "key", "h", "m", "row", "row1", "row2", "copies", "n_tokens", "place", "taken", "a.b`c"]
    rows = docs.select("*", *(F.lit(77).alias(c) for c in names), F.create_map(F.lit("k"), F.col("doc_id")).alias("map"), F.parse_json(F.lit('{"x": 1}')).alias("any"))
    out = mixing.plan(rows, repeats=1.4)
    assert out.count() == docs.count() and out.where("start <> 77 or rest <> 77 or n <> 77 or `a.b``c` <> 77 or row <> 77").count() == 0
    assert out.where("weight = 77").count() == 0
    assert mixing.realise(rows, budget_share=None, repeats=1.0).where("weight = 77 and map is not null and any is not null").count() == docs.count()


def test_least_budget_takes_every_row(docs):
    out = mixing.realise(docs, budget_share=None, repeats=2.0)
    assert out.columns == docs.columns
    counts = {str(r[:-1]): r["count"] for r in out.groupBy(*docs.columns).count().collect()}
    assert len(counts) == docs.distinct().count()
    most = out.groupBy("doc_id", "source").count().where("source = 'c'").agg(F.max("count")).first()[0]
    assert most == 2 and out.where("source = 'a' and text <> ''").count() == 300


def test_least_budget_short_by_rounding(spark):
    """At many tokens the due of the largest source can fall short of its tokens by rounding."""
    for size in (10**11, 10**12 + 7, 3 * 10**13 + 1):
        big = [(i, f"={i % 7}", size // (i % 7 + 3) + i, i, -i) for i in range(70)]
        rows = spark.createDataFrame(big, "id int, key string, n long, row1 long, row2 long").withColumn("row", F.struct("id"))
        out = mixing._placed(rows, budget_share=None, repeats=1.5)
        assert out.count() == 70 and out.where("passes < 1").count() == 0


def test_edges(spark, docs):
    assert mixing.plan(docs.where("false"), repeats=2.0).count() == 0
    blank = docs.withColumn("text", F.lit(None).cast("string"))
    assert {r["copies"] for r in mixing.plan(blank, entropy=0.5).collect()} == {1}
    assert {r["copies"] for r in mixing.plan(docs.where("source = 'a'"), repeats=3.0).where("n_tokens > 0").collect()} == {1}
    odd = spark.createDataFrame(brute.awkward(["a b", "c"]), brute.DOCS)
    assert mixing.plan(odd, repeats=2.0).count() == odd.count()
    with pytest.raises(ValueError):
        mixing.plan(docs, repeats=1.0, entropy=0.5)
