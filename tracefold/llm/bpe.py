"""Byte-level BPE: whole texts to token ids and back.

Two tiers. A minimal perfect hash (hash and displace) over the vocabulary resolves a
pre-token that is itself a token; any other pre-token is merged with a heap of adjacent
pairs over doubly linked bytes, in O(n log n). Each worker remembers the pre-tokens it
has met in a table of bounded size in front of both tiers.

Nulls are read as empty texts; an empty text has no tokens and hashes as the empty
string. Texts of any length are encoded whole. Other columns are never touched.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ._common import text_of

MEMO_LIMIT, SLICE = 200_000, 256


def load_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a tiktoken rank file, read on the driver."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for word, rank in pairs:
        tokens[int(rank)] = base64.b64decode(word)
    return tokens


class PerfectHash:
    """Minimal perfect hash of byte strings; a lookup hashes twice and compares once."""

    def __init__(self, keys: list[bytes], load: int = 4):
        n = self.size = len(keys)
        self.keys, self.width = [b""] * n, max(1, n // load)
        self.ranks = [-1] * n
        self.shift = [0] * self.width
        groups: dict[int, list[tuple[int, int]]] = {}
        for rank, key in enumerate(keys):
            h = xxhash.xxh64_intdigest(key)
            groups.setdefault(h % self.width, []).append((h, rank))
        if len({h for members in groups.values() for h, _ in members}) < n:
            raise ValueError("keys repeat, or their hashes do")
        free = bytearray(b"\1") * n
        singles = []
        for bucket, members in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                singles.append((bucket, members[0]))
                continue
            d = 1
            while True:
                slots = {self._slot(h, d) for h, _ in members}
                if len(slots) == len(members) and all(free[s] for s in slots):
                    break
                d += 1
            self.shift[bucket] = d
            for h, rank in members:
                self._put(self._slot(h, d), keys[rank], rank, free)
        spare = (s for s in range(n) if free[s])
        for bucket, (_, rank) in singles:
            slot = next(spare)
            self.shift[bucket] = -slot - 1
            self._put(slot, keys[rank], rank, bytearray(n))

    def _slot(self, h: int, d: int) -> int:
        """A slot that each displacement draws anew, so the search for one always ends."""
        return (((h ^ d * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> 32) % self.size

    def _put(self, slot: int, key: bytes, rank: int, free: bytearray) -> None:
        self.keys[slot], self.ranks[slot] = key, rank
        free[slot] = 0

    def get(self, key: bytes) -> int:
        """The rank of ``key``, or -1."""
        if not self.size:
            return -1
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.width]
        slot = -d - 1 if d < 0 else self._slot(h, d)
        return self.ranks[slot] if self.keys[slot] == key else -1


class Codec:
    """Encoder and decoder for one vocabulary and one pre-token pattern."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern, self.hash = tokens, pattern, PerfectHash(tokens)
        self._ready()

    def _ready(self) -> None:
        self.split = regex.compile(self.pattern).findall
        self.memo, self.near = _Table(lambda piece: self.piece(piece.encode())), _Table(self.hash.get)
        self.digits = [str(i) for i in range(len(self.tokens))]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "memo", "near", "digits")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def piece(self, word: bytes) -> tuple[int, ...]:
        whole = self.hash.get(word)
        return (whole,) if whole >= 0 else self.merge(word)

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Repeatedly join the adjacent pair of lowest rank, leftmost first."""
        n, rank = len(word), self.near.__getitem__
        end = list(range(1, n + 1))
        back = list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) >= 0]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j] = 0
            end[i] = stop
            if stop < n:
                back[stop] = i
                if (r := rank(word[i : end[stop]])) >= 0:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := back[i]) >= 0 and (r := rank(word[h:stop])) >= 0:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(rank(word[i : end[i]]))
            i = end[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        for table in (self.memo, self.near):
            if len(table) > MEMO_LIMIT:
                table.turn()
        return list(chain.from_iterable(map(self.memo.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decimal(self, ids: list[int]) -> str:
        return " ".join(map(self.digits.__getitem__, ids))


class _Table(dict):
    """What was computed lately, in two generations: a full young one replaces the old one."""

    longest = 64

    def __init__(self, compute):
        self.compute, self.old = compute, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            self[key] = value
        return value

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()


def shared_codec(spark: SparkSession, path: str, pattern: str):
    """A codec in a broadcast variable; a rank file is a fixed vocabulary, so its size is bounded."""
    return spark.sparkContext.broadcast(Codec(load_ranks(path), pattern))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with an array of token ids."""
    codec = shared_codec(docs.sparkSession, path, pattern)

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([codec.value.encode(t) for t in batch])

    return docs.withColumn(into, ids(text_of(text)))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of an array of token ids, null and unknown ids left out."""
    codec = shared_codec(docs.sparkSession, path, pattern)

    @F.pandas_udf("binary")
    def back(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            size = len(codec.value.tokens)
            yield pd.Series([codec.value.decode([int(i) for i in x if i is not None and 0 <= i < size]) for x in batch])

    return docs.withColumn(into, back(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


_DIGEST = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]


def digest(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text", into: str = "bpe", with_ids: bool = False) -> DataFrame:
    """The ``keep`` columns with a struct of the token count and the hashes of the ids and of their decoding.

    Unless ``with_ids`` adds them as a field ``ids``, the ids never leave the worker. An
    Arrow batch is answered in slices of ``SLICE`` rows, so a worker holds the ids of few.
    """
    codec = shared_codec(docs.sparkSession, path, pattern)
    kept = docs.select(*keep, text_of(text).alias("__txt"))
    fields = _DIGEST + [StructField("ids", ArrayType(IntegerType()))] * with_ids
    schema = StructType([*kept.schema.fields[:-1], StructField(into, StructType(fields))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
        c = codec.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found: list[list] = [[] for _ in fields]
                for t in part.column(part.num_columns - 1).to_pylist():
                    ids = c.encode(t)
                    row = (len(ids), sha(c.decimal(ids).encode()), sha(c.decode(ids)), np.array(ids, dtype=np.int32))
                    for column, value in zip(found, row):
                        column.append(value)
                made = pa.StructArray.from_arrays([pa.array(v, type=k) for v, k in zip(found, kinds)], names=[f.name for f in fields])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=schema.names)

    return kept.mapInArrow(run, schema)
