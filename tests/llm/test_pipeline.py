"""The pipeline and the registered queries over the smallest tables."""

import math

import brute
import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from tracefold.llm import mixing, quality, secrets, simhash
from tracefold.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def stages(spark, documents, tmp_path_factory):
    docs, out = documents, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_keep_the_columns(documents, stages):
    assert all(s.columns == documents.columns for s in stages[:-1])


def test_each_stage_against_a_plain_version(spark, documents, stages):
    field = quality.train(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r.asDict() for r in documents.collect()]
    good = [r for r in rows if field.score(r["text"] or "") >= quality.THRESHOLD]
    assert sorted(r["doc_id"] for r in stages[0].collect()) == sorted(r["doc_id"] for r in good)

    fp = [simhash.fingerprint(r["text"] or "") for r in good]
    root = brute.classes(len(good), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3)
    first = {}
    for r, c in zip(good, root):
        first[c] = min(first.get(c, math.inf), r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[1].collect()) == sorted(first.values())

    before = {r["doc_id"]: r for r in stages[1].collect()}
    for r in stages[2].collect():
        old = before[r["doc_id"]]["text"]
        base = brute.base_spans(old, brute.SECRETS)[1]
        assert brute.base_spans(r["text"], brute.SECRETS)[0] == [0, 0, 0]
        assert (secrets.MARK in r["text"]) if base else True
        assert r["n_chars"] == (len(r["text"]) if r["text"] != old else before[r["doc_id"]]["n_chars"])

    copies = stages[3].groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in copies} == set(before) and {r["count"] for r in copies} <= {1, 2}
    assert stages[4].count() == stages[3].count()


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "n_tokens", "ids_sha256"]
    assert sorted(got.select(key).collect()) == sorted(stages[-1].select(key).collect())


def test_stages_take_awkward_rows(spark, documents):
    rows = spark.createDataFrame([r[:5] for r in brute.awkward(["some plain text here", "token = abcdefgh1234"])], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (rows, rows.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() >= (0 if docs is not rows or name == "quality classifier" else 1)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_returns_rows_of_the_contract(spark, name):
    table = "embeddings" if name.split("_")[0] in ("op5", "op6") else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    rows = QUERIES[name](spark, SF)
    if name == "op5_topk":
        asked = spark.read.parquet(f"{SF}/embeddings.parquet").where(F.col("vec_id") % 50 == 0).count()
        assert rows.count() == 5 * asked
    else:
        assert rows.count() == n
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("embeddings", "documents", "benchmark"):
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        cols = sorted(rows.columns)
        want = con.sql(ORACLES[name]).select(*cols).fetchall()
        key = [cols.index(c) for c in cols if c in ("doc_id", "vec_id", "query_id", "rank")]
        ordered = lambda found: sorted(map(tuple, found), key=lambda r: [r[i] for i in key])
        got, want = ordered(rows.select(*cols).collect()), ordered(want)
        assert len(got) == len(want) and all(a == pytest.approx(b, abs=1e-5) for a, b in zip(got, want))


def test_spans_of_the_registered_queries(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for name, kinds in (("op1_pii", brute.PII), ("op10_secrets", brute.SECRETS)):
        for r in QUERIES[name](spark, SF).collect():
            counts, base = brute.base_spans(texts[r["doc_id"]], kinds)
            assert [r[f"n_{k}"] for k in kinds] == counts and r["base_sha256"] == brute.sha(base)


def test_mix_of_the_registered_query(spark):
    out = QUERIES["op9_mixing"](spark, SF)
    total = out.agg(F.sum("n_tokens"), F.sum(F.col("copies") * F.col("n_tokens"))).first()
    assert total[1] <= total[0] and mixing.BLOCK
