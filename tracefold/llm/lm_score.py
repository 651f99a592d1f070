"""Cross-entropy difference between a target and a background n-gram model.

Both models are word bigrams over one vocabulary, the words of both corpora and one unknown,
smoothed alike: a pair's probability leans on the single word with the weight of ``LEAN``
observations. Every word and every pair of either corpus counts, so what is gathered grows
with the input. A document's score is the mean of its per-token differences, loss under the
target less loss under the background: the lower, the closer to the target. Words are runs
of non-space after lower-casing A-Z.

Texts are split once into chunks of about ``CHUNK`` tokens. A chunk counts its own words and
pairs and sends each with its count, once, to the bucket that its hash falls into; a bucket
of hashes adds up the counts of all chunks and answers each chunk with the sums for its keys,
in their order. So the most common pair is one entry a chunk, a bucket holds about
``ENTRIES`` entries at any input size, and the driver sees three sums.

Keys are 86 bits of hash, which sorted and packed take 8 bytes; among 1e12 different pairs,
any two share a key with a chance of 0.6 %.

Null texts are empty; a document without words has 0 tokens and zero losses. Rows are scored
one by one, repeated rows and repeated ids alike. An empty target leaves its model uniform;
an empty table gives no rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ._common import saved, text_of

CHUNK, ENTRIES, LEAN = 1_000_000, 1_000_000, 16.0
_SENT = "bucket int, chunk long, side int, a binary, b binary, n binary, c binary"
_SUMS = "chunk long, bucket int, n0 binary, n1 binary, c0 binary, c1 binary, words long"


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes, equal places of all values together: high bytes are mostly zero."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit of the input moves all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sorted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    order = np.argsort(a, kind="stable")
    x, y = a[order], b[order]
    return np.lexsort((b, a)) if ((x[1:] == x[:-1]) & (y[1:] < y[:-1])).any() else order


def _hash(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """88 bits of each word, as 64 and 24."""
    h = np.frombuffer(b"".join(blake2b(w, digest_size=16).digest() for w in words), dtype=np.uint64).reshape(-1, 2)
    return h[:, 0].copy(), (h[:, 1] >> np.uint64(40)).astype(np.uint32)


_START = _hash([b""])  # the start of a text is the word of no bytes


class Maker:
    """Gathers texts into a row of the store: word numbers in the order of their hashes, 0 the start."""

    def __init__(self, side: int, part: int, fields: int):
        self.side, self.next, self.fields = side, (side << 62) + (part << 28), fields
        self.begin()

    def begin(self) -> None:
        self.index, self.ids, self.lengths, self.keys = {b"": 0}, array("i"), array("i"), [[] for _ in range(self.fields)]

    def add(self, keys: tuple, text: str) -> None:
        words, index = words_of(text), self.index
        self.ids.extend([index.setdefault(w, len(index)) for w in words])
        self.lengths.append(len(words))
        for held, k in zip(self.keys, keys):
            held.append(k)

    def row(self, types: list[pa.DataType]) -> pa.RecordBatch:
        a, b = _hash(list(self.index)[1:])
        order = np.argsort(a, kind="stable")
        place = np.zeros(len(a) + 1, dtype=np.int32)
        place[order + 1] = np.arange(1, len(a) + 1, dtype=np.int32)
        ids = place[np.frombuffer(self.ids, dtype=np.int32)] if self.ids else np.empty(0, dtype=np.int32)
        packed = [pack(ids), pack(np.array(self.lengths, dtype=np.int32)), pack(np.diff(a[order], prepend=np.uint64(0))), pack(b[order])]
        columns = [pa.array([self.next]), pa.array([self.side], pa.int32()), pa.array([len(ids)], pa.int64())]
        columns += [pa.array([k], pa.list_(t)) for k, t in zip(self.keys, types)]
        columns += [pa.array([x], pa.binary()) for x in packed]
        self.next += 1
        self.begin()
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "side", "tokens", *(f"k{i}" for i in range(self.fields)), *_PACKED])


_PACKED = ["ids", "lengths", "a", "b"]


class Chunk:
    """Word and predecessor of each token of some texts, and the keys of what they hold: words, then pairs."""

    def __init__(self, row: dict):
        ids = unpack(row["ids"], np.int32).astype(np.int64)
        self.lengths = unpack(row["lengths"], np.int32).astype(np.int64)
        a = np.concatenate([_START[0], np.cumsum(unpack(row["a"], np.uint64), dtype=np.uint64)])
        b = np.concatenate([_START[1], unpack(row["b"], np.uint32)]).astype(np.uint64)
        self.size = size = len(a)
        before = np.zeros_like(ids)
        before[1:] = ids[:-1]
        some = self.lengths > 0
        before[np.cumsum(self.lengths)[some] - self.lengths[some]] = 0
        first = np.bincount(before, minlength=size).astype(np.int64)
        word = np.bincount(ids, minlength=size).astype(np.int64)
        before *= size
        before += ids
        self.pairs, self.which, seen = np.unique(before, return_inverse=True, return_counts=True)
        p, w = np.divmod(self.pairs, size)
        one, odd, two = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(2)
        mixed = _mixed(a), _mixed(a * odd + b)
        tail = (_mixed(mixed[1][p] + a[w] * odd + b[w] * one) >> np.uint64(42)) * two
        self.a = np.concatenate([_mixed(a + one), _mixed(mixed[0][p] + a[w])])
        # the lowest bit tells words from pairs
        self.b = np.concatenate([b >> np.uint64(2) << np.uint64(1) | np.uint64(1), tail]).astype(np.uint32)
        self.n = np.concatenate([word, seen])
        self.c = np.concatenate([first, np.zeros(len(seen), dtype=np.int64)])
        self.order = _sorted(self.a, self.b)

    def losses(self, n: np.ndarray, c: np.ndarray, total: int, words: int) -> np.ndarray:
        """Mean loss of each text under one side, from the sums of all keys and of the words as first ones, in sorted order."""
        full, first = np.empty(len(self.a)), np.empty(len(self.a))
        full[self.order] = n
        first[self.order[self.order < self.size]] = c
        single, pair = full[: self.size], full[self.size :]
        p, w = np.divmod(self.pairs, self.size)
        lean = LEAN * (single[w] + 0.5) / (total + 0.5 * (words + 1))
        loss = -np.log((pair + lean) / (first[p] + LEAN))
        text = np.repeat(np.arange(len(self.lengths)), self.lengths)
        return np.bincount(text, loss[self.which], minlength=len(self.lengths)) / np.maximum(self.lengths, 1)


def _chunks(df: DataFrame, keys: list[str], text: str, side: int, like: StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, types = Maker(side, TaskContext.get().partitionId(), len(keys)), []
        for batch in batches:
            types = [f.type for f in batch.schema][:-1]
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for row in zip(*(c.to_pylist() for c in piece.columns)):
                    made.add(row[:-1], row[-1])
                    if len(made.ids) >= CHUNK:
                        yield made.row(types)
        if made.lengths:
            yield made.row(types)

    return df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), text_of(text).alias("t")).mapInArrow(run, like)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield from batch.slice(at, 1).to_pylist()


def _send(buckets: int):
    """One row for each chunk and bucket: sorted keys of the bucket with the chunk's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row)
            a, b, n, c = (x[chunk.order] for x in (chunk.a, chunk.b, chunk.n, chunk.c))
            at = ((a >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            ends = np.append(starts[1:], len(at))
            for i in range(0, len(starts), 64):
                out = []
                for s, e in zip(starts[i : i + 64].tolist(), ends[i : i + 64].tolist()):
                    words = (b[s:e] & np.uint32(1)).astype(bool)
                    out.append((int(at[s]), row["chunk"], row["side"], pack(np.diff(a[s:e], prepend=np.uint64(0))), pack(b[s:e]), pack(n[s:e]), pack(c[s:e][words])))
                kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["bucket", "chunk", "side", "a", "b", "n", "c"])

    return run


def _add(rows: pa.Table) -> pa.Table:
    """The sums over all chunks for the keys of each, in its order; a row of chunk -1 counts the bucket's words."""
    found = rows.to_pylist()
    a = [np.cumsum(unpack(r["a"], np.uint64), dtype=np.uint64) for r in found]
    sizes = [len(x) for x in a]
    a, b, n = np.concatenate(a), np.concatenate([unpack(r["b"], np.uint32) for r in found]), np.concatenate([unpack(r["n"], np.int64) for r in found])
    words = (b & np.uint32(1)).astype(bool)
    c = np.zeros_like(n)
    c[words] = np.concatenate([unpack(r["c"], np.int64) for r in found])
    order = _sorted(a, b)
    a, b = a[order], b[order]
    starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    side = np.repeat([r["side"] for r in found], sizes)
    group = np.empty(len(a), dtype=np.int64)
    group[order] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(a)))
    sums = {f"{k}{s}": np.add.reduceat(np.where(side == s, x, 0)[order], starts) for k, x in (("n", n), ("c", c)) for s in (0, 1)}
    different = int(((b[starts] & np.uint32(1) == 1) & (sums["n0"] + sums["n1"] > 0)).sum())
    ends = np.cumsum(sizes)
    own = [(r["chunk"], slice(e - k, e)) for r, e, k in zip(found, ends, sizes) if r["side"] == 0]
    answer = {name: [b""] + [pack(x[group[at][words[at]] if name[0] == "c" else group[at]]) for _, at in own] for name, x in sums.items()}
    more = len(own)
    first = {"chunk": pa.array([-1, *(k for k, _ in own)], pa.int64()), "bucket": pa.array([found[0]["bucket"]] * (more + 1), pa.int32())}
    return pa.table({**first, **{k: pa.array(v, pa.binary()) for k, v in answer.items()}, "words": pa.array([different] + [0] * more, pa.int64())})


def score(docs: DataFrame, target: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` of every row of ``docs`` with tokens, both losses and their difference."""
    kinds = [docs.schema[k].dataType for k in keys]
    like = StructType().add("chunk", "long").add("side", "integer").add("tokens", "long")
    result = StructType()
    for i, (k, t) in enumerate(zip(keys, kinds)):
        like, result = like.add(f"k{i}", ArrayType(t)), result.add(k, t)
    for c in _PACKED:
        like = like.add(c, "binary")
    for c, t in (("n_tokens", "long"), ("target_loss", "double"), ("background_loss", "double"), ("score", "double")):
        result = result.add(c, t)
    same = target.select(*(F.lit(None).cast(t).alias(k) for k, t in zip(keys, kinds)), F.col(text))
    store = saved(_chunks(docs, keys, text, 0, like).unionByName(_chunks(same, keys, text, 1, like)))
    totals = {r["side"]: r["n"] for r in store.groupBy("side").agg(F.sum("tokens").alias("n")).collect()}
    n = [totals.get(s, 0) for s in (0, 1)]

    sent = store.select("chunk", "side", *_PACKED).mapInArrow(_send(max(1, -(-sum(n) // ENTRIES))), _SENT)
    sums = saved(sent.groupBy("bucket").applyInArrow(_add, _SUMS))
    n_words = sums.agg(F.sum("words")).first()[0] or 0

    def losses(found: pa.Table, rows: pa.Table) -> pa.Table:
        parts = sorted(found.to_pylist(), key=lambda r: r["bucket"])
        values = {k: np.concatenate([np.empty(0, dtype=np.int64), *(unpack(r[k], np.int64) for r in parts)]) for k in ("n0", "n1", "c0", "c1")}
        chunk = Chunk(rows.to_pylist()[0])
        t, b = (chunk.losses(values[f"n{s}"], values[f"c{s}"], n[s], n_words) for s in (1, 0))
        columns = [rows[f"k{i}"].combine_chunks().flatten() for i in range(len(keys))]
        return pa.table([*columns, *map(pa.array, (chunk.lengths, t, b, t - b))], names=result.names)

    own = store.where("side = 0").select("chunk", *(f"k{i}" for i in range(len(keys))), *_PACKED)
    return sums.where("chunk >= 0").drop("words").groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(losses, result)
