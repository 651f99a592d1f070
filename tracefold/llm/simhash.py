"""SimHash fingerprints and their near-duplicate classes.

Fingerprints that differ in at most 3 of 64 bits differ in at most 3 of 8 bytes, so at
least 5 bytes agree by position. The inverted index is keyed by position and value of
three bytes at a time: of any 5 agreeing positions, 3 lie in the same half of the
fingerprint, so the 8 triples within the halves list every such pair. A pair that meets
in a posting list is tallied over all 8 positional bytes, kept from 5 matches on, then
verified by its differing bits.

Equal fingerprints are folded into one before anything is compared, large posting lists
are compared in blocks, and only spanning links leave a task. A null text is empty; a
text without words has fingerprint zero and is linked like any other. Rows with a null id
are fingerprinted and linked; they don't name a component. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._buckets import compare, forest
from ._common import ROW, components, packed, pick, row_key, saved, text_of, unpacked

SEED, SHINGLE, MAX_BITS = 42, 3, 3
TRIPLES = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]


def fingerprint(text: str) -> int:
    """Majority bits of the XXH64 of all word shingles, as unsigned."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles, n = [b" ".join(words)], 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))), len(words) - SHINGLE + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=n)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fp") -> DataFrame:
    """``docs`` with a signed long fingerprint; no shuffle."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(t) for t in batch], dtype=np.uint64).view(np.int64))

    return docs.withColumn(into, run(text_of(text)))


def _links(members: pd.DataFrame, side: np.ndarray | None) -> pd.DataFrame | None:
    ids = members["node"].to_numpy()
    fp = ids.view(np.uint64)
    differ = fp[:, None] ^ fp[None, :]
    tally = (differ.view(np.uint8).reshape(len(fp), len(fp), 8) == 0).sum(axis=2, dtype=np.uint8)
    linked = tally >= 8 - MAX_BITS
    if side is not None:
        linked &= side[:, None] != side[None, :]
    kept = np.nonzero(linked)
    linked[kept] = np.bitwise_count(differ[kept]) <= MAX_BITS
    a, b = forest(linked, ids)
    return pd.DataFrame({"a": a, "b": b}) if len(a) else None


def near_links(nodes: DataFrame, block: int = 256) -> DataFrame:
    """Spanning links ``(a, b)`` between distinct fingerprints (column ``node``)."""
    byte = lambda i: F.shiftrightunsigned("node", 8 * i).bitwiseAND(255)
    keys = [F.lit(k << 24) + byte(a) * 65536 + byte(b) * 256 + byte(c) for k, (a, b, c) in enumerate(TRIPLES)]
    postings = nodes.select("node", F.explode(F.array(*keys)).alias("bucket"))
    return compare(postings, _links, "a long, b long", block)


def classes(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``(ident, fp, component)`` a row of ``docs``; component is the smallest id reachable."""
    base = saved(fingerprints(docs.select(F.col(ident).alias("ident"), F.col(text).alias("text"))).select("ident", "fp"))
    nodes = saved(base.groupBy(F.col("fp").alias("node")).agg(F.min("ident").alias("low")))
    roots = saved(components(near_links(nodes)))
    placed = nodes.join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("low").alias("component"))
    named = saved(placed.join(least, "root").select(F.col("node").alias("fp"), "component"))
    return base.join(named, "fp").select("ident", "fp", "component")


def keep_one(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of each class: the smallest id, and of rows that share it one."""
    key = row_key(docs)
    base = saved(fingerprints(docs.select(*key, F.col(ident).alias("ident"), F.col(text).alias("text"))).select(*ROW, "ident", "fp"))
    best = F.min(F.struct(F.col("ident").isNull().alias("void"), "ident", *ROW))
    nodes = saved(base.groupBy(F.col("fp").alias("node")).agg(best.alias("best")))
    roots = saved(components(near_links(nodes)))
    placed = nodes.join(roots, "node", "left").select("best", F.coalesce("root", "node").alias("root"))
    kept = saved(placed.groupBy("root").agg(F.min("best").alias("best")).select(*(F.col(f"best.{c}").alias(c) for c in ROW)))
    return pick(docs.select(packed(docs.columns), *key), kept).select(*unpacked(docs.columns))
