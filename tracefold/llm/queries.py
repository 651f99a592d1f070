"""One query for each operator of the subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, licences, lm_score, mixing, pii, quality, secrets, simhash, topk
from ._common import table

#: No source is passed over more than this often within a budget of all tokens.
MIX_REPEATS = 1.5
BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _span_digest(found: DataFrame, kinds: list[str]) -> DataFrame:
    return found.select("doc_id", *(f"n_{k}" for k in kinds), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(pii.spans(table(spark, sf_dir, "documents"), ["doc_id"]), pii.BASE)


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs).select("doc_id", "licence.*")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digest(docs, BPE_RANKS, public_tokenizers.PATTERN, ["doc_id"]).select("doc_id", "bpe.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, field)
    return scored.select("doc_id", F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("ident") % 50 == 0)


def op6_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embed_dedup.classes(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("ident").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("ident") == F.col("component"), F.lit(False)).alias("kept"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(table(spark, sf_dir, "documents"))
    return out.select(F.col("ident").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much closer each document is to the benchmark passages than to the whole corpus."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_score.score(docs, table(spark, sf_dir, "benchmark"), ["doc_id"])
    return scored.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.plan(docs, repeats=MIX_REPEATS)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(secrets.spans(table(spark, sf_dir, "documents"), ["doc_id"]), secrets.BASE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_licences": op2_licences,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality": op4_quality,
    "op5_topk": op5_topk,
    "op6_embed_dedup": op6_embed_dedup,
    "op7_simhash": op7_simhash,
    "op8_lm_score": op8_lm_score,
    "op9_mixing": op9_mixing,
    "op10_secrets": op10_secrets,
}

_FINITE = "list_transform(embedding, lambda x: cast(x as double)) as v from embeddings where embedding is not null and not list_contains(list_transform(embedding, lambda x: x is null or isnan(x) or isinf(x)), true)"
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+')"


def _lm_side(side: int) -> str:
    """Loss of a token under one model, from the tables of op8_lm_score's SQL."""
    return f"-ln((k.n{side} + {lm_score.LEAN} * ((u.n{side} + 0.5) / (t.n{side} + 0.5 * ((select count(*) from u) + 1)))) / (c.n{side} + {lm_score.LEAN}))"


ORACLES: dict[str, str] = {
    "op8_lm_score": f"""with a as (select 0 as side, row_number() over () as row, doc_id, {_WORDS} as ws from documents union all select 1, row_number() over (), null, {_WORDS} from benchmark),
        e as (select side, row, unnest(ws) as w, generate_subscripts(ws, 1) as i from a), d as (select *, coalesce(lag(w) over (partition by side, row order by i), '') as p from e),
        t as (select count(*) filter (side = 0) as n0, count(*) filter (side = 1) as n1 from d),
        u as (select w, count(*) filter (side = 0) as n0, count(*) filter (side = 1) as n1 from d group by w),
        c as (select p, count(*) filter (side = 0) as n0, count(*) filter (side = 1) as n1 from d group by p),
        k as (select p, w, count(*) filter (side = 0) as n0, count(*) filter (side = 1) as n1 from d group by p, w),
        l as (select row, {_lm_side(1)} as target, {_lm_side(0)} as background from d cross join t join u on u.w = d.w join c on c.p = d.p join k on k.p = d.p and k.w = d.w where side = 0),
        m as (select row, count(*) as n, avg(target) as target, avg(background) as background from l group by row)
        select doc_id, coalesce(n, 0) as n_tokens, coalesce(round(target, 6), 0) as target_loss, coalesce(round(background, 6), 0) as background_loss, coalesce(round(target - background, 6), 0) as score from a left join m using (row) where side = 0""",
    "op5_topk": f"""with q as (select vec_id, list_transform(v, lambda x: floor(256 * x)) as v from (select vec_id, {_FINITE})),
        s as (select a.vec_id as query_id, b.vec_id, cast(list_dot_product(a.v, b.v) as bigint) as score from q a join q b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v)),
        r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s) select query_id, rank, vec_id, score from r where rank <= 5""",
    "op6_embed_dedup": f"""with recursive u as (select vec_id, label, {_FINITE}), w as (select * from u where label is not null and list_dot_product(v, v) > 0),
        p as (select a.vec_id as a, b.vec_id as b from w a join w b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
        g as (select vec_id as start, vec_id as node from embeddings union select start, b from g join p on node = a),
        c as (select start, min(node) as component_id from g group by start)
        select e.vec_id, (select count(*) from p where a = e.vec_id) as n_links, component_id, e.vec_id = component_id as kept from embeddings e join c on start = e.vec_id""",
}
