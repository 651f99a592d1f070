"""From raw documents to encoded training rows, stage by stage.

Each stage takes and returns a table with the columns of ``documents``; the last returns
encoded rows. Between stages a table is written and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import bpe, mixing, quality, secrets, simhash
from tracefold.llm._common import fresh, saved, table

#: No source is passed over more than this often, each at least once.
REPEATS = 2.0
BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field, trained on the labels of this input, doesn't reject."""
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    into = fresh(docs, "score")
    return quality.score(docs, field, into=into).where(F.col(into) >= quality.THRESHOLD).drop(into)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one of smallest id."""
    return simhash.keep_one(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; ``n_chars`` follows the text."""
    before = fresh(docs, "before")
    out = secrets.redact(docs.withColumn(before, F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col(before))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least; documents of smaller sources again, up to the limit."""
    return mixing.realise(docs, budget_share=None, repeats=REPEATS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.digest(docs, BPE_RANKS, public_tokenizers.PATTERN, ["doc_id", "lang", "source"], with_ids=True)
    return out.select("doc_id", "lang", "source", "bpe.*")


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", keep_one),
    ("secret scan", hide_secrets),
    ("source mixing", mix),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else saved(docs), sf_dir)
    return docs
