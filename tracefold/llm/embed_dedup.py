"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines.

Vectors of the same label are scaled to length 1; cosine c is then distance
sqrt(2 - 2c). ``TABLES`` hash tables of ``BITS`` quantised Gaussian projections
floor((a.x + b) / WIDTH) put close vectors into one bucket; members of a bucket are
compared exactly in double precision. At cosine 0.98 one projection agrees with
probability 0.84, a table with 0.25, one table of 20 with 0.997, closer pairs more often.

Equal vectors are folded into a class before hashing and count as links of one another.
A pair that shares several buckets counts in the first table only. Buckets of any size
are compared whole, in blocks. Vectors are scaled by a power of two first, so very large and
very small components neither overflow nor vanish.

A row whose label is null or whose vector is null, zero or holds null or non-finite
components has no links and is its own component. Vectors of different length are never
linked. Rows that repeat a vec_id are rows of their own; a component is named by its
smallest non-null vec_id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._buckets import compare, forest
from ._common import components, saved

TABLES, BITS, WIDTH, LEAST, SEED = 20, 8, 1.0, 0.98, 17
USABLE = "label is not null and vec is not null and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(vec, x -> x <> 0)"


def _projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.normal(size=(dim, TABLES * BITS)), rng.uniform(0, WIDTH, TABLES * BITS)


def hashed(vectors: DataFrame) -> DataFrame:
    """``vectors`` (column ``vec``) with an array of one long a table."""

    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept: dict[int, tuple] = {}
        odd = np.random.default_rng(SEED).integers(1, 1 << 62, size=BITS, dtype=np.int64) | 1
        for batch in batches:
            out: list = [None] * len(batch)
            sizes = np.array([len(v) for v in batch])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                a, b = kept.setdefault(int(dim), _projections(int(dim)))
                x = np.stack([np.asarray(batch.iloc[i], dtype=float) for i in at])
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                cells = np.floor((x @ a + b) / WIDTH).astype(np.int64).reshape(len(at), TABLES, BITS)
                with np.errstate(over="ignore"):
                    codes = (cells * odd).sum(axis=2)
                for i, row in zip(at, codes):
                    out[i] = row
            yield pd.Series(out)

    return vectors.withColumn("codes", run("vec"))


def _links(members: pd.DataFrame, side: np.ndarray | None) -> pd.DataFrame | None:
    ids = members["node"].to_numpy()
    sizes = members["vec"].map(len).to_numpy()
    x = np.zeros((len(ids), sizes.max()))
    for i, v in enumerate(members["vec"]):
        x[i, : len(v)] = v
    # a power of two leaves all digits as they are, and keeps squares within range
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    norm = np.sqrt((x * x).sum(axis=1))
    with np.errstate(all="ignore"):
        linked = (x @ x.T) / np.outer(norm, norm) >= LEAST
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    for c in (sizes, members["label"].to_numpy(), members["table"].to_numpy()):
        linked &= c[:, None] == c[None, :]
    if not linked.any():
        return None
    codes = np.stack(members["codes"].to_list())
    first = linked.copy()
    for t in range(int(members["table"].iloc[0])):
        first &= codes[:, t][:, None] != codes[:, t][None, :]
    n = first @ members["n"].to_numpy()
    a, b = forest(linked, ids)
    some = np.flatnonzero(n)
    return pd.concat([pd.DataFrame({"a": a, "b": b, "n": 0}), pd.DataFrame({"a": ids[some], "b": -1, "n": n[some]})], ignore_index=True)


def classes(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = 256) -> DataFrame:
    """``(ident, n_links, component)``, one row of every row of ``vectors``."""
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(ident).alias("ident"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    base = saved(rows.withColumn("usable", F.expr(USABLE)).withColumn("k1", F.xxhash64("label", "vec")).withColumn("k2", F.xxhash64("vec", "label", F.lit(SEED))))
    usable = base.where("usable")
    folded = usable.groupBy("k1", "k2").agg(F.min("row").alias("node"), F.min("ident").alias("low"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    folded = saved(hashed(folded))
    buckets = folded.select("node", F.posexplode("codes").alias("table", "code"), F.col("label").alias("own"), F.size("vec").alias("dim"))
    buckets = buckets.select("node", "table", F.xxhash64("own", "table", "code", "dim").alias("bucket"))
    met = saved(compare(buckets, _links, "a long, b long, n long", block, folded.select("node", "label", "vec", "codes", "n")))
    roots = saved(components(met.where("b >= 0").select("a", "b")))
    counts = met.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    placed = saved(folded.select("k1", "k2", "node", "low", "n").join(roots, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = placed.groupBy("root").agg(F.min("low").alias("component"))
    named = saved(placed.join(least, "root").select("k1", "k2", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component"))
    linked = usable.select("ident", "k1", "k2").join(named, ["k1", "k2"]).select("ident", "n_links", "component")
    alone = base.where("not usable").select("ident", F.lit(0).cast("long").alias("n_links"), F.col("ident").alias("component"))
    return linked.unionByName(alone)
