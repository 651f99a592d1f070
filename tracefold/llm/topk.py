"""Exact top-k inner products of integer vectors for a stated set of queries.

Vectors are put into bands by descending length and slabs of about ``SLAB`` within a
band. The first slab gives every query a lower bound for its k-th score. Queries go into
blocks of about ``BLOCK`` by length, so that those of a block have like bounds, and a block
then meets only the slabs whose greatest length could still reach its lowest bound. A slab
is sent once a block that it meets. Within a slab, vectors go by descending length; in axes rotated by
the singular vectors of a bounded sample, the leading ``LEAD`` coordinates give a partial
sum and Cauchy-Schwarz bounds the rest, so only pairs that may still enter the list are
scored, with exact integers.

The rotation only orders the work; it is fitted on about ``SAMPLE_ROWS`` rows of lowest hashes.

Vectors that are null or hold null or non-finite components take no part; an empty vector
has score 0 with empty vectors; vectors of different length are never compared. Ties go to
the smaller id, then the earlier row. Rows that repeat an id are candidates and queries of
their own; a null id is a candidate after all others and no query. Without queries or
candidates there are no rows. Vectors so long that a product of two could pass 63 bits
raise an error rather than give wrong ranks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import hashed_share, saved

SLAB, BLOCK, BANDS, SAMPLE_ROWS, LEAD, STEP, STRETCHES = 4096, 4096, 32, 1024, 16, 512, 32
_OUT = "q_row long, query_id long, c_row long, vec_id long, score long"


def quantised(vectors: DataFrame, ident: str, vector: str, scale: int) -> DataFrame:
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(ident).cast("long").alias("ident"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where("v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf'))")
    rows = rows.select("row", "ident", F.expr(f"transform(v, x -> floor({scale}D * x))").alias("vec"))
    return rows.withColumn("length", F.expr("sqrt(aggregate(vec, 0D, (s, x) -> s + cast(x as double) * x))"))


def _rotation(base: DataFrame) -> np.ndarray:
    """Right singular vectors, leading first, of the sample's most common dimension."""
    rows = hashed_share(base, F.col("row"), SAMPLE_ROWS).select("vec").collect()
    sizes = [len(r["vec"]) for r in rows]
    if not sizes or not max(sizes):
        return np.eye(1)
    dim = max(sorted(set(sizes) - {0}), key=sizes.count)
    x = np.array([r["vec"] for r in rows if len(r["vec"]) == dim], dtype=float)
    return np.linalg.svd(x, full_matrices=True)[2].T if len(x) else np.eye(dim)


def _matrix(vecs: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(vecs), dim), dtype=np.int64)
    for i, v in enumerate(vecs):
        out[i, : len(v)] = v
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where no sum can pass 2^53, else in integers."""
    if np.abs(q).max(initial=0).astype(float) * np.abs(c).max(initial=0).astype(float) * max(1, q.shape[1]) < 2.0**53:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    return q @ c.T


def search(queries: pd.DataFrame, found: pd.DataFrame, axes: np.ndarray, k: int) -> pd.DataFrame:
    """The candidates of one slab that may be among the k best of each query of one block."""
    q_size, c_size = queries["vec"].map(len).to_numpy(), found["vec"].map(len).to_numpy()
    dim = int(max(q_size.max(initial=0), c_size.max(initial=0)))
    found = found.iloc[np.argsort(-found["length"].to_numpy(), kind="stable")]
    c_size = found["vec"].map(len).to_numpy()
    q, c = _matrix(queries["vec"], dim), _matrix(found["vec"], dim)
    turn = axes if len(axes) == dim else np.eye(dim)
    qr, cr = q @ turn, c @ turn
    lead = min(LEAD, dim)
    q_rest, c_rest = (np.sqrt((x[:, lead:] ** 2).sum(axis=1)) for x in (qr, cr))
    q_len, c_len = queries["length"].to_numpy(), found["length"].to_numpy()
    q_row, c_row = queries["row"].to_numpy(), found["row"].to_numpy()
    c_id = found["ident"].to_numpy(dtype=float, na_value=np.inf) if found["ident"].isna().any() else found["ident"].to_numpy()
    bound = queries["bound"].to_numpy(dtype=float)
    slack = 1e-6 * (1 + q_len.max(initial=0) * c_len.max(initial=0))
    best: list[list[tuple]] = [[] for _ in q]
    for at in range(0, len(c), STEP):
        part = slice(at, at + STEP)
        if (q_len * c_len[at] + slack < bound).all():
            break
        may = qr[:, :lead] @ cr[part, :lead].T + np.outer(q_rest, c_rest[part]) + slack >= bound[:, None]
        may &= (q_size[:, None] == c_size[None, part]) & (q_row[:, None] != c_row[None, part])
        some = np.flatnonzero(may.any(axis=0))
        if not len(some):
            continue
        score = _products(q, c[part][some])
        may = may[:, some] & (score >= bound[:, None])
        for i in np.flatnonzero(may.any(axis=1)):
            j = np.flatnonzero(may[i])
            rows = at + some[j]
            if len(j) > k:
                order = np.lexsort((c_row[rows], c_id[rows], -score[i, j]))[:k]
                j, rows = j[order], rows[order]
            best[i] += zip((-score[i, j]).tolist(), c_id[rows].tolist(), c_row[rows].tolist(), rows.tolist())
            best[i] = sorted(best[i])[:k]
            if len(best[i]) == k:
                bound[i] = max(bound[i], -best[i][-1][0])
    out = [(q_row[i], r, -s, x) for i, b in enumerate(best) for s, _, r, x in b]
    frame = pd.DataFrame(out, columns=["q_row", "c_row", "score", "at"])
    frame["vec_id"] = found["ident"].to_numpy()[frame["at"].to_numpy(dtype=int)] if len(frame) else 0
    return frame.merge(queries[["row", "ident"]].rename(columns={"row": "q_row", "ident": "query_id"}), on="q_row")[["q_row", "query_id", "c_row", "vec_id", "score"]]


def _meet(queries: DataFrame, slabs: DataFrame, axes: np.ndarray, k: int) -> DataFrame:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in _OUT.split(", ")})
        return search(left, right, axes, k)

    return queries.groupBy("block", "slab").cogroup(slabs.groupBy("block", "slab")).applyInPandas(run, _OUT)


def _blocked(asked: DataFrame) -> tuple[DataFrame, int]:
    """Queries with their block: one of ``STRETCHES`` stretches of length, dealt into parts of about ``BLOCK``."""
    total = asked.count()
    stretches = max(1, min(STRETCHES, total // BLOCK))
    cuts = asked.agg(F.percentile_approx("length", [i / stretches for i in range(1, stretches)], 10000)).first()[0] or [] if stretches > 1 else []
    cuts = sorted(set(cuts))
    stretch = F.expr("0" + "".join(f" + case when length > {c!r}D then 1 else 0 end" for c in cuts))
    asked = asked.withColumn("stretch", stretch)
    sizes = {r["stretch"]: r["n"] for r in asked.groupBy("stretch").agg(F.count("*").alias("n")).collect()}
    parts = [-(-sizes.get(i, 1) // BLOCK) for i in range(len(cuts) + 1)]
    starts = [sum(parts[:i]) for i in range(len(parts))]
    pick = lambda values: "element_at(array({}), stretch + 1)".format(", ".join(map(str, values)))
    return asked.withColumn("block", F.expr(f"cast({pick(starts)} + pmod(xxhash64(row, 3), {pick(parts)}) as int)")).drop("stretch"), sum(parts)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best other rows of every query row.

    ``is_query`` is a condition on the column ``ident`` of this module (the id as long).
    """
    base = saved(quantised(vectors, ident, vector, scale))
    axes = _rotation(base)
    cuts, far = base.agg(F.percentile_approx("length", [i / BANDS for i in range(BANDS - 1, 0, -1)], 10000), F.max("length")).first()
    cuts = cuts or []
    if far and far * far >= 2.0**63:
        raise OverflowError("vectors too long for 64-bit scores")
    cuts = sorted(set(cuts), reverse=True)
    band = F.expr("0" + "".join(f" + case when length < {c!r}D then 1 else 0 end" for c in cuts))
    banded = base.withColumn("band", band)
    sizes = {r["band"]: (r["n"], r["most"]) for r in banded.groupBy("band").agg(F.count("*").alias("n"), F.max("length").alias("most")).collect()}
    bands = sorted(sizes)
    parts = "element_at(array({}), band + 1)".format(", ".join(str(-(-sizes.get(b, (1, 0))[0] // SLAB)) for b in range(len(cuts) + 1)))
    slabs = banded.withColumn("slab", F.expr(f"band * 4294967296L + pmod(xxhash64(row), {parts})")).select("slab", "row", "ident", "vec", "length")
    asked = base.where(is_query & F.col("ident").isNotNull())
    asked, blocks = _blocked(asked)
    asked = saved(asked)
    top = bands[0] * 4294967296 if bands else 0
    seeds = saved(
        _meet(
            asked.withColumns({"slab": F.lit(top), "bound": F.lit(float("-inf"))}),
            slabs.where(F.col("slab") == top).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))),
            axes,
            k,
        )
    )
    kth = seeds.groupBy(F.col("q_row").alias("row")).agg(F.count("*").alias("n"), F.min("score").alias("low")).where(f"n >= {k}").select("row", F.col("low").cast("double").alias("bound"))
    bounded = saved(asked.join(kth, "row", "left").fillna(float("-inf"), ["bound"]))
    reach = bounded.groupBy("block").agg(F.max("length").alias("far"), F.min("bound").alias("need"))
    every = "flatten(array({}))".format(", ".join(f"case when far * {sizes[b][1]!r}D * (1 + 1e-9) + 1 >= need then transform(sequence(0, {-(-sizes[b][0] // SLAB) - 1}), i -> {b * 4294967296}L + i) else array() end" for b in bands) or "cast(array() as array<bigint>)")
    pairs = saved(reach.select("block", F.explode(F.expr(every)).alias("slab")).where(F.col("slab") != top))
    rest = _meet(bounded.join(pairs, "block"), slabs.join(pairs, "slab"), axes, k)
    best = Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "c_row")
    ranked = seeds.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}")
    return ranked.select("query_id", "rank", "vec_id", "score")
