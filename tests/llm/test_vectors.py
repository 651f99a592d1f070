import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.llm import _common, embed_dedup, simhash, topk

VECS = "vec_id long, embedding array<float>, label int, node long, score int"


def vectors(n: int, seed: int = 0) -> list:
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, 8))
    rows = []
    for i in range(n):
        v = base[i % len(base)] + rng.normal(size=8) * (0.0 if i % 5 == 0 else 0.08)
        rows.append((i, [float(np.float32(x)) for x in v], i % 2, 7, 3))
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0], [1.0, 2.0]]
    rows += [(n + i, v, 1, 7, 3) for i, v in enumerate(odd)]
    return [*rows, (n + 50, rows[0][1], None, 7, 3), (None, rows[1][1], 1, 7, 3), rows[2], rows[2]]


def test_top_k_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "SLAB", 16)
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "STEP", 5)
    rows = vectors(120)
    frame = spark.createDataFrame(rows, VECS).coalesce(1)
    got = topk.top_k(frame, F.col("ident") % 5 == 0).collect()
    want = brute.top([r[0] for r in rows], [r[1] for r in rows], 5, 5)
    ids = [r[0] for r in rows]
    assert sorted((r["query_id"], r["rank"], r["vec_id"] or -1, r["score"]) for r in got) == sorted((ids[i], k, v or -1, s) for i, k, v, s in want)


def test_top_k_edges(spark):
    frame = spark.createDataFrame(vectors(8), VECS)
    assert topk.top_k(frame.where("false"), F.col("ident") % 5 == 0).count() == 0
    assert topk.top_k(frame, F.lit(False)).count() == 0
    huge = spark.createDataFrame([(0, [3e6, 1.0]), (1, [3e6, -2.0]), (2, [-3e6, 9.0])], "vec_id long, embedding array<double>")
    assert [r["score"] for r in topk.top_k(huge, F.col("ident") == 0).orderBy("rank").collect()] == [768000000**2 - 256 * 512, -(768000000**2) + 256 * 2304]


def test_near_vectors_against_all_pairs(spark):
    rows = vectors(160)
    frame = spark.createDataFrame(rows, VECS).coalesce(1)
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]

    def linked(i, j):
        if not (ok[i] and ok[j]) or rows[i][2] != rows[j][2] or len(rows[i][1]) != len(rows[j][1]):
            return False
        a, b = np.array(rows[i][1]), np.array(rows[j][1])
        return a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= embed_dedup.LEAST

    n = len(rows)
    links = [sum(linked(i, j) for j in range(n) if j != i) for i in range(n)]
    root = brute.classes(n, linked)
    low = [min((rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None), default=None) for i in range(n)]
    want = sorted((-1 if rows[i][0] is None else rows[i][0], links[i], low[i]) for i in range(n))
    for block in (3, 256):
        got = embed_dedup.classes(frame, block=block).collect()
        assert sorted((-1 if r["ident"] is None else r["ident"], r["n_links"], r["component"]) for r in got) == want
    assert sum(links) > 200


def test_near_vectors_empty(spark):
    assert embed_dedup.classes(spark.createDataFrame([], VECS)).count() == 0


def texts() -> list:
    rng = np.random.default_rng(3)
    out = []
    for g in range(12):
        words = [f"w{rng.integers(500)}" for _ in range(200)]
        for _ in range(6):
            copy = list(words)
            copy[int(rng.integers(200))] = "changed"
            out.append(" ".join(copy))
    return [*out, "two words", "Two  WORDS", "one"]


@pytest.mark.parametrize("block", [3, 256])
def test_simhash_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(simhash.near_links, "__defaults__", (block,))
    rows = brute.awkward(texts())
    docs = spark.createDataFrame(rows, brute.DOCS)
    fp = [simhash.fingerprint(r[1] or "") for r in rows]
    root = brute.classes(len(rows), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3)
    low = [min((rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None), default=None) for i in range(len(rows))]
    got = simhash.classes(docs).collect()
    key = lambda i, f, c: (-1 if i is None else i, f % 2**64, c)
    assert sorted(key(r["ident"], r["fp"], r["component"]) for r in got) == sorted(key(rows[i][0], fp[i], low[i]) for i in range(len(rows)))
    assert len({c for c in low}) < len(rows) - 20


def test_simhash_fingerprint_by_the_book():
    import xxhash

    text = "One two\tthree  four two three FOUR one"
    words = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(" \n") == 0 and simhash.fingerprint("A b") == xxhash.xxh64_intdigest("a b", 42)


def test_keep_one(spark):
    rows = brute.awkward(texts())
    docs = spark.createDataFrame(rows, brute.DOCS)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    component = {r["component"] for r in simhash.classes(docs).collect()}
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(c for c in component if c is not None)
    assert simhash.keep_one(docs.where("false")).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(5, 5), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in _common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 0 for i in range(40)) and got[201] == 200
    assert _common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_top_k_beyond_64_bits(spark):
    frame = spark.createDataFrame([(0, [1e15, 1.0]), (1, [-1e15, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(OverflowError):
        topk.top_k(frame, F.col("ident") == 0)


def test_top_k_queries_in_stretches_of_length(spark, monkeypatch):
    monkeypatch.setattr(topk, "SLAB", 16)
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "STRETCHES", 4)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6) * 10.0 ** (i % 4)]) for i in range(150)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = topk.top_k(frame, F.col("ident") % 5 == 0).collect()
    want = brute.top([r[0] for r in rows], [r[1] for r in rows], 5, 5)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_vectors_of_any_size(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 1.01e200]), (2, [1e-200, 1.01e-200]), (3, [5e-324, 0.0]), (4, [1e308, 0.0]), (5, [0.0, 1e-300])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r["ident"]: (r["n_links"], r["component"]) for r in embed_dedup.classes(frame).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (1, 3), 4: (1, 3), 5: (0, 5)}


def test_keep_one_of_rows_with_any_columns(spark):
    docs = spark.createDataFrame([(2, "a b c d"), (1, "a b c d"), (None, "x y z"), (3, "x y z"), (3, "x y z")], "doc_id long, text string")
    docs = docs.select("*", *(F.lit(77).alias(c) for c in ("row", "row1", "row2", "fp", "ident", "best", "a.b`c")), F.create_map(F.lit("k"), F.col("doc_id")).alias("map"), F.parse_json(F.lit("[1]")).alias("any"))
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["row"], r["a.b`c"], r["map"]["k"]) for r in out.collect()) == [(1, 77, 77, 1), (3, 77, 77, 3)]


def test_no_scratch_folder_off_one_machine(spark):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "spark://x:7077", "getConf": staticmethod(lambda: Cluster.conf)})

    with pytest.raises(RuntimeError):
        _common.scratch_dir(Cluster)
