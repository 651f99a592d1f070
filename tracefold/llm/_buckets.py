"""Compare the members of hashed buckets, however large a bucket is.

A bucket of more than ``block`` members is dealt into blocks by a hash of the member
and one task handles one pair of blocks, so no task holds a whole hot bucket and every
pair of a bucket still meets exactly once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import saved


def compare(rows: DataFrame, fn: Callable[[pd.DataFrame, np.ndarray | None], pd.DataFrame | None], schema: str, block: int = 256, payload: DataFrame | None = None) -> DataFrame:
    """``fn(members, side)`` for every block pair of every bucket.

    ``rows`` has ``bucket`` (long), ``node`` (long) and maybe more columns; ``payload``, one
    row a ``node``, joins only the rows whose bucket holds several. ``side`` is None
    when all pairs of ``members`` are due, else a boolean array that tells the two blocks
    apart and only pairs across are due.
    """
    counts = saved(rows.groupBy("bucket").agg(F.count("*").alias("bucket_n")).where("bucket_n > 1"))
    shared = rows.join(counts, "bucket")
    if payload is not None:
        shared = shared.join(payload, "node")
    dealt = (
        shared.withColumn("nb", F.ceil(F.col("bucket_n") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node", "bucket"), F.col("nb")).cast("int"))
        .withColumn("pair", F.explode(F.expr("transform(sequence(0, nb - 1), x -> cast(least(own, x) as long) * nb + greatest(own, x))")))
        .drop("bucket_n")
        .repartition("bucket", "pair")
        .sortWithinPartitions("bucket", "pair")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            cuts = _cuts(batch)
            if len(cuts):
                yield from _groups(batch.iloc[: cuts[-1]], cuts[:-1], fn)
            rest = batch.iloc[cuts[-1] :] if len(cuts) else batch
        if rest is not None and len(rest) > 1:
            yield from _groups(rest, np.empty(0, dtype=int), fn)

    return dealt.mapInPandas(run, schema)


def _cuts(batch: pd.DataFrame) -> np.ndarray:
    k, p = batch["bucket"].to_numpy(), batch["pair"].to_numpy()
    return np.flatnonzero((k[1:] != k[:-1]) | (p[1:] != p[:-1])) + 1


def _groups(batch: pd.DataFrame, cuts: np.ndarray, fn: Callable) -> Iterator[pd.DataFrame]:
    ends = np.append(cuts, len(batch))
    starts = np.insert(cuts, 0, 0)
    wide = np.flatnonzero(ends - starts > 1)
    nb, own, pair = (batch[c].to_numpy() for c in ("nb", "own", "pair"))
    found = []
    for i in wide:
        s, e = starts[i], ends[i]
        first, second = divmod(int(pair[s]), int(nb[s]))
        side = None if first == second else own[s:e] == first
        out = fn(batch.iloc[s:e], side)
        if out is not None and len(out):
            found.append(out)
        if len(found) >= 256:
            yield pd.concat(found, ignore_index=True)
            found = []
    if found:
        yield pd.concat(found, ignore_index=True)


def forest(linked: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the smallest id of each component of a symmetric boolean matrix."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    low = rank.copy()
    while True:
        new = np.minimum(low, np.where(linked, low[None, :], n).min(axis=1))
        new = new[order[new]] if n else new
        if (new == low).all():
            break
        low = new
    move = low != rank
    return ids[move], ids[order[low[move]]]
