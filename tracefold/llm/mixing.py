"""Mix sources to target weights by temperature, and realise the mix in whole documents.

A source with share p of all tokens gets weight p^a / sum p^a. The exponent a in [0, 1] is
the smallest for which the weights meet the target: an entropy of at most ``entropy``
(as a share of the greatest possible), or no source passed over more than ``repeats``
times within the budget. It is bisected, several levels a job: a job evaluates a grid of
exponents over the table of sources, and only the grid comes back.

A weight times the budget is a source's tokens: so many whole passes, and a rest. For the
rest, documents are dealt into hashed blocks of about ``BLOCK`` over all sources, blocks
and documents within them run in hash order (a permutation seeded by ``seed``), running
totals over groups of blocks and over blocks say where each begins, and a document is taken
as long as the total up to its end is within the rest. The hash covers the whole row. Rows
that are wholly alike are one with a count until then, so the choice doesn't depend on how
rows lie in partitions, and no task holds more than a block's rows.

DataFrame and SQL functions only. Null sources are one source; null texts are empty;
documents of no tokens get the whole passes of their source, and the pass of the rest if
their place is within it; those of a source without any tokens are taken once. Without any
tokens every document is taken once. An empty table gives no rows. Rows are taken one by
one, also where ids repeat. Columns may have any names and types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import ROW, packed, pick, row_key, saved, text_of, unpacked, without

BLOCK, GRID, JOBS = 512, 31, 6


def exponent(sources: DataFrame, budget_share: float | None, entropy: float | None, repeats: float | None) -> float:
    """Smallest exponent that meets the target; ``sources`` has column ``p``, above 0.

    Without a budget, the passes of the others are counted against the least passed one's.
    """
    if (entropy is None) == (repeats is None):
        raise ValueError("give either an entropy or a repetition limit")
    if budget_share is None and repeats is not None and repeats < 1:
        raise ValueError("a repetition limit below one pass leaves no budget")
    most = sources.agg(F.log(F.count("*").cast("double"))).first()[0] or 0.0
    low, high = 0.0, 1.0
    for job in range(JOBS):
        step = (high - low) / (GRID + 1)
        points = [low] * (job == 0) + [low + step * (i + 1) for i in range(GRID)]
        grid = sources.select("p", F.explode(F.array(*map(F.lit, points))).alias("a")).withColumn("w", F.expr("pow(p, a)"))
        sums = grid.groupBy("a").agg(F.sum("w").alias("z"), F.sum(F.expr("w * a * ln(p)")).alias("e"), F.max(F.expr("w / p")).alias("r"), F.min(F.expr("w / p")).alias("least"))
        if repeats is None:
            met = F.expr("ln(z) - e / z") <= entropy * most + 1e-12
        elif budget_share is None:
            met = F.expr("r / least") <= repeats
        else:
            met = F.expr("r / z") * budget_share <= repeats
        good = [r["a"] for r in sums.where(met).select("a").collect()]
        if job == 0 and 0.0 in good:
            return 0.0
        high = min(good, default=high)
        low = max((x for x in points if x < high), default=low)
    return high


def plan(docs: DataFrame, source: str = "source", text: str = "text", budget_share: float | None = 1.0, entropy: float | None = None, repeats: float | None = None, seed: int = 42) -> DataFrame:
    """``docs`` without its text, with ``n_tokens``, ``weight`` and ``copies``.

    ``budget_share`` is the budget over all tokens; None is the least budget with which no
    source falls short of one whole pass; there, rounding takes no pass away. Columns named
    like one of the new ones give way to it.
    """
    keep = without([c for c in docs.columns if c != text], ["n_tokens", "weight", "copies"])
    alike = _placed(docs.select(packed(keep), *_measured(docs, source, text)), budget_share, entropy, repeats, seed)
    rows = alike.withColumn("place", F.explode(F.expr("sequence(1L, m)")))
    copies = F.col("passes") + F.when(F.col("place") <= F.col("taken"), 1).otherwise(0)
    return rows.select(*unpacked(keep), F.col("n").alias("n_tokens"), "weight", copies.cast("long").alias("copies"))


def realise(docs: DataFrame, source: str = "source", text: str = "text", **target) -> DataFrame:
    """``docs``, each row as often as ``plan`` takes it."""
    alike = _placed(docs.select(packed([]), *_measured(docs, source, text)), **target)
    chosen = saved(alike.select(*ROW, (F.col("passes") * F.col("m") + F.col("taken")).alias("copies")).where("copies > 0"))
    repeated = pick(docs.select(packed(docs.columns), *row_key(docs)), chosen).select("row", F.explode(F.expr("sequence(1L, copies)")))
    return repeated.select(*unpacked(docs.columns))


def _measured(docs: DataFrame, source: str, text: str) -> list[Column]:
    """The source's key, tokens and row key."""
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    tokens = F.regexp_count(text_of(text), F.lit(r"[^ \t-\r]+")).cast("long")
    return [key.alias("key"), tokens.alias("n"), *row_key(docs)]


def _placed(rows: DataFrame, budget_share: float | None = 1.0, entropy: float | None = None, repeats: float | None = None, seed: int = 42) -> DataFrame:
    """Rows that are wholly alike as one: ``m`` of them, each ``passes`` times, ``taken`` once more."""
    same = rows.groupBy(*ROW).agg(*(F.first(c).alias(c) for c in ("row", "key", "n")), F.count("*").alias("m"))
    same = saved(same.withColumn("h", F.xxhash64(F.lit(seed), *ROW)))
    per = saved(same.groupBy("key").agg(F.sum(F.expr("n * m")).alias("tokens"), F.count("*").alias("rows")))
    total, count = per.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    if not total:
        return same.withColumns({"weight": F.lit(0.0), "passes": F.lit(1).cast("long"), "taken": F.lit(0).cast("long")})
    shares = saved(per.where("tokens > 0").select("key", "tokens", (F.col("tokens") / total).alias("p")))
    a = exponent(shares, budget_share, entropy, repeats)
    z, least = shares.agg(F.sum(F.expr(f"pow(p, {a!r}D)")), F.min(F.expr(f"pow(p, {a!r}D) / p"))).first()
    budget = z / least if budget_share is None else budget_share
    weighed = shares.withColumn("weight", F.expr(f"pow(p, {a!r}D) / {z!r}D")).withColumn("due", F.expr(f"weight * {budget * total!r}D + 1e-6"))
    weighed = weighed.withColumn("passes", F.greatest(F.expr("cast(floor(due / tokens) as bigint)"), F.lit(1 if budget_share is None else 0)))
    weighed = weighed.withColumn("rest", F.expr("greatest(due - passes * tokens, 0)"))
    weighed = saved(weighed.select("key", "weight", "passes", "rest"))

    dealt = same.withColumn("b", F.pmod("h", F.lit(-(-count // BLOCK))))
    held = saved(dealt.groupBy("key", F.expr(f"b div {BLOCK}").alias("group"), "b").agg(F.sum(F.expr("n * m")).alias("own")))
    ahead = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = held.groupBy("key", "group").agg(F.sum("own").alias("sum"))
    groups = saved(groups.withColumn("first", F.coalesce(F.sum("sum").over(ahead("key", "group")), F.lit(0))).drop("sum"))
    inner = held.withColumn("inner", F.coalesce(F.sum("own").over(ahead("key", "group", "b")), F.lit(0)))
    starts = inner.join(groups, ["key", "group"]).join(weighed, "key", "left")
    starts = saved(starts.select("key", "b", F.expr("first + inner").alias("start"), "weight", "passes", "rest"))
    before = F.sum(F.expr("n * m")).over(Window.partitionBy("key", "b").orderBy("h", *ROW).rowsBetween(Window.unboundedPreceding, -1))
    placed = dealt.withColumn("before", F.coalesce(before, F.lit(0))).join(starts, ["key", "b"])
    room = "coalesce(rest, -1D) - start - before"
    taken = f"case when n = 0 then if({room} >= 0, m, 0L) else greatest(0L, least(m, cast(floor(({room}) / n) as bigint))) end"
    return placed.withColumn("taken", F.expr(taken)).withColumns({"weight": F.coalesce("weight", F.lit(0.0)), "passes": F.coalesce("passes", F.lit(1))})
