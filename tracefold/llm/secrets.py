"""Secrets in texts: fixed shapes, and strings that look drawn at random.

Two character Markov models of first order, one of random strings and one of ordinary
identifiers, are compared by log-likelihood ratio. The labelled samples: values that the
fixed shapes find in the whole table and strings drawn from SHA-256 are random; runs of
8 and more identifier characters from about ``SAMPLE_ROWS`` texts (lowest hashes, equal
texts once) that no fixed shape covers and that hold fewer than 3 digits are ordinary. Transition counts are DataFrame aggregates of at most 128 x 128
cells, so the model has a fixed size and is applied as a literal.

DataFrame and SQL functions only. Null texts are empty, an empty text has no spans, rows
are handled one by one (repeated rows alike), an empty table trains on the drawn strings
and returns no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import hashed_share, packed, saved, text_of, unpacked, without
from ._spans import apart, joined, located, masked, quoted

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
    "random": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
}
BASE = ["assign", "access", "hex"]
ORDER = [*BASE, "random"]
SAMPLE_ROWS, DRAWN = 2000, 2000
#: A run is a secret from this log-likelihood ratio on, in all and for each transition.
LEAST_TOTAL, LEAST_MEAN = 12.0, 0.5
#: Transitions lean on single characters with the weight of so many observations.
LEAN = 8.0
MARK = "[SECRET]"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def candidates(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``row`` (the ``keep`` columns), ``base`` spans and ``runs`` that no base span touches."""
    out = docs.select(packed(keep), text_of(text).alias("t")).select("row", F.expr(located("t", PATTERNS)).alias("every"))
    holds = (
        f"case x.kind when 'assign' then length(regexp_extract(x.m, {quoted(ASSIGN)}, 1)) >= 8"
        " when 'access' then length(x.m) >= 16 when 'hex' then true else false end"
    )
    out = out.withColumn("base", F.expr(f"filter(every, x -> {holds})"))
    return out.withColumn("runs", F.expr(apart("filter(every, x -> x.kind = 'random')", "base"))).drop("every")


def _transitions(words: DataFrame) -> dict[tuple[int, int], int]:
    """Counts of adjacent character codes of column ``w``."""
    codes = words.select(F.expr("transform(split(w, ''), c -> ascii(c))").alias("c"))
    pairs = codes.select(F.explode(F.expr("transform(slice(c, 2, greatest(size(c) - 1, 0)), (b, i) -> c[i] * 128 + b)")).alias("p"))
    return {divmod(r["p"], 128): r["n"] for r in pairs.groupBy("p").agg(F.count("*").alias("n")).collect()}


def train(found: DataFrame, docs: DataFrame, text: str = "text") -> list[float]:
    """128 x 128 log-likelihood ratios of transitions, random over ordinary."""
    spark = found.sparkSession
    value = f"case when x.kind = 'assign' then regexp_extract(x.m, {quoted(ASSIGN)}, 1) else x.m end"
    real = found.select(F.explode(F.expr(f"transform(base, x -> {value})")).alias("w"))
    drawn = spark.range(DRAWN).select(F.explode(F.expr("array(sha2(cast(id as string), 256), base64(unhex(sha2(cast(id as string), 256))), upper(conv(left(sha2(cast(-id as string), 256), 15), 16, 36)))")).alias("w"))
    sample = hashed_share(docs.select(text_of(text).alias("t")), F.col("t"), SAMPLE_ROWS).groupBy(F.xxhash64("t").alias("h")).agg(F.first("t").alias("t"))
    plain = F.regexp_replace("t", ASSIGN + "|" + PATTERNS["access"] + "|" + PATTERNS["hex"], " ")
    known = sample.select(F.explode(F.regexp_extract_all(plain, F.lit(r"[A-Za-z0-9+/_=-]{8,}+"), F.lit(0))).alias("w"))
    known = known.where(F.regexp_count("w", F.lit("[0-9]")) < 3)
    # what the fixed shapes find weighs no more than the drawn strings, else one alphabet hides the rest
    return _ratios([_transitions(real), _transitions(drawn)], [_transitions(known)])


def _ratios(random: list[dict], ordinary: list[dict]) -> list[float]:
    codes = [ord(c) for c in ALPHABET]

    def model(parts: list[dict]) -> dict[int, list[float]]:
        rows: dict[int, list[float]] = {a: [0.0] * 128 for a in codes}
        for counts in parts:
            single = {b: sum(counts.get((a, b), 0) for a in codes) for b in codes}
            n = sum(single.values())
            for a in codes:
                own = [counts.get((a, b), 0) for b in codes]
                for b, c in zip(codes, own):
                    lean = (single[b] + 0.5) / (n + 0.5 * len(codes))
                    rows[a][b] += (c + LEAN * lean) / (sum(own) + LEAN) / len(parts)
        return rows

    r, o = model(random), model(ordinary)
    out = [0.0] * (128 * 128)
    for a in codes:
        for b in codes:
            out[a * 128 + b] = round(math.log(r[a][b] / o[a][b]), 4)
    return out


def decide(found: DataFrame, ratios: list[float]) -> DataFrame:
    """``found`` with ``spans``: base spans, and runs whose ratio is high enough."""
    literal = "array(" + ",".join(f"{v}D" for v in ratios) + ")"
    codes = "transform(split(x.m, ''), c -> ascii(c))"
    score = f"aggregate(transform(slice({{c}}, 2, size({{c}}) - 1), (b, i) -> element_at({literal}, {{c}}[i] * 128 + b + 1)), 0D, (p, q) -> p + q)"
    out = found.withColumn("coded", F.expr(f"transform(runs, x -> named_struct('x', x, 'c', {codes}))"))
    out = out.withColumn("scored", F.expr(f"transform(coded, z -> named_struct('x', z.x, 'v', {score.format(c='z.c')}))"))
    good = f"z.v >= {LEAST_TOTAL}D and z.v >= {LEAST_MEAN}D * (length(z.x.m) - 1)"
    out = out.withColumn("spans", F.expr(f"concat(base, transform(filter(scored, z -> {good}), z -> z.x))"))
    return out.drop("coded", "scored")


def spans(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns with counts, the joined base and all spans, and the spans themselves.

    Columns to keep that are named like one of these give way to it.
    """
    keep = without(keep, [*(f"n_{k}" for k in BASE), "base", "spans", "found"])
    found = saved(candidates(docs, keep, text))
    out = decide(found, train(found, docs, text))
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)")
    return out.select(*unpacked(keep), *(count(k).alias(f"n_{k}") for k in BASE), joined("base", BASE).alias("base"), joined("spans", ORDER).alias("spans"), F.col("spans").alias("found"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret replaced by ``MARK``; null texts stay null, other columns as they are.

    The rows are written once with their candidates, so that no text is searched twice.
    """
    found = saved(candidates(docs, docs.columns, text))
    ratios = train(found, found.select(F.col("row").getField(text).alias("t")), "t")
    out = decide(found, ratios).withColumn("t", F.col("row").getField(text).cast("string"))
    clean = F.when(F.size("spans") == 0, F.col("t")).otherwise(F.expr(masked("t", "spans", MARK)))
    return out.select(*(clean.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))
