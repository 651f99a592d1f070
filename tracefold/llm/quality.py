"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are counts and shares of its characters and
words, and those of the lines before and after it; the chain links neighbouring labels.
Training lines carry the label of their document. The marginals of the forward-backward
recursion, weighted by line length, average to the share of good text, and a logistic
curve with one slope and one offset turns that share into the probability of label 1.

The weights maximise one objective: the sum over training documents of the conditional
log-likelihood of their lines, each document weighted by 1 / lines and both classes alike,
less the ridges ``RIDGE`` on emissions and ``RIDGE_MOVES`` on transitions.

The field is fitted on about ``rows`` labelled rows (lowest hashes) outside the held-out
fold. Of a document of more than ``lines`` lines, as many train, in up to ``RUNS`` runs of
neighbouring lines spread evenly over all of it. These two parameters bound what the driver
holds; features are made where the rows are. Whatever is scored is scored whole. Inputs are
the text alone.

Null texts are read as empty; an empty text is one empty line and has a score like any
other. Labels that are null or not 0 or 1, and rows whose text is missing, don't train;
with fewer than two classes every score is the share of label 1 (0.5 without labels).
Repeated rows score alike; extra columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import hashed_share, saved, text_of

SAMPLE_ROWS, SAMPLE_LINES, RUNS, FOLDS, THRESHOLD = 3000, 1024, 8, 5, 0.3
RIDGE, RIDGE_MOVES, ROUNDS, CELLS, WIDE, SLICE = 1.0, 40.0, 150, 400_000, 48, 256
_UP, _LOW, _DIGIT, _SPACE, _STOP, _MARK = range(1, 7)


def _classes() -> bytes:
    kind = bytearray([0]) * 256
    for b in range(256):
        c = chr(b)
        if b >= 128 or c.islower():
            kind[b] = _LOW
        elif c.isupper():
            kind[b] = _UP
        elif c.isdigit():
            kind[b] = _DIGIT
        elif c.isspace():
            kind[b] = _SPACE
        elif c in ".,;:?'\"()-":
            kind[b] = _STOP
        else:
            kind[b] = _MARK
    return bytes(kind)


_KIND = _classes()
OWN = ["upper", "digit", "mark", "stop", "repeated", "word_length", "long_word", "marked_word", "log_length", "capital_first", "ends_stop", "empty"]


def line_features(line: str) -> list[float]:
    raw = line.encode()
    if not raw.strip():
        return [0.0] * (len(OWN) - 1) + [1.0]
    kinds = raw.translate(_KIND)
    n = len(raw)
    up, low, digit, stop, mark = (kinds.count(k) for k in (_UP, _LOW, _DIGIT, _STOP, _MARK))
    words = raw.split()
    m = len(words)
    shapes = b" ".join(words).translate(_KIND).split(bytes([_SPACE]))
    odd = sum(s[-1] == _MARK for s in shapes)
    return [
        up / max(1, up + low),
        digit / n,
        min(1.0, 5 * mark / n),
        min(1.0, 5 * stop / n),
        1 - len(set(words)) / m,
        min(2.0, n / m / 8),
        min(1.0, max(map(len, words)) / 40),
        odd / m,
        min(2.0, np.log1p(n) / 5),
        float(shapes[0][0] == _UP),
        float(raw[-1:] in b".!?"),
        0.0,
    ]


def own_features(lines: list[str]) -> np.ndarray:
    return np.array([line_features(x) for x in lines], dtype=np.float32).reshape(-1, len(OWN))


def neighbours(own: np.ndarray) -> np.ndarray:
    """Rows of (own, before, after, bias) features."""
    edge = np.zeros((1, len(OWN)), dtype=np.float32)
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), np.ones((len(own), 1), dtype=np.float32)])


@dataclass
class Field:
    """Weights of emissions (score of good less bad) and of the four transitions."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    def emissions(self, lines: list[str]) -> np.ndarray:
        """Scores of good less bad; a line's features meet the three parts of the weights apart."""
        k = len(OWN)
        parts = self.weights[: 3 * k].reshape(3, k).T
        each = np.concatenate([own_features(lines[i : i + 4096]) @ parts for i in range(0, len(lines), 4096)])
        out = each[:, 0] + self.weights[-1]
        out[1:] += each[:-1, 1]
        out[:-1] += each[1:, 2]
        return out

    def shares(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean of P(good) over the lines of each text."""
        split = [t.split("\n") for t in texts]
        good = marginals([self.emissions(x) for x in split], self.moves)
        return np.array([np.average(g, weights=[len(x) + 1.0 for x in lines]) for g, lines in zip(good, split)])

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.shares(texts) + self.offset, -30, 30)))

    def score(self, text: str) -> float:
        return float(self.scores([text])[0])


def _step(f, moves: np.ndarray):
    """Log odds of the next label from those of this one, its own emission left out."""
    return np.logaddexp(moves[0, 1], moves[1, 1] + f) - np.logaddexp(moves[0, 0], moves[1, 0] + f)


def _walk(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log odds of good given the emissions up to each line, one sequence."""
    (a, b), (c, d) = np.exp(moves).tolist()
    log, exp, out, at = math.log, math.exp, [], None
    for s in scores.tolist():
        if at is None:
            at = s
        else:
            e = exp(min(at, 500.0))
            at = s + log((b + d * e) / (a + c * e))
        out.append(at)
    return np.array(out)


def _odds(scores: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """``_walk`` of each sequence; those of like length go together, a step for all that are still on."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    out: list[np.ndarray] = [np.empty(0)] * len(scores)
    while order:
        longest = len(scores[order[0]])
        block = order[: max(1, CELLS // max(1, longest))]
        lengths = np.array([len(scores[i]) for i in block])
        if len(block) < WIDE or lengths[WIDE - 1] * 4 < longest:
            out[order[0]] = _walk(scores[order[0]], moves)
            order = order[1:]
            continue
        order = order[len(block) :]
        alive = np.searchsorted(-lengths, -np.arange(longest), side="left")
        at = np.zeros((longest, len(block)))
        for k, i in enumerate(block):
            at[: lengths[k], k] = scores[i]
        for t in range(1, longest):
            n = alive[t]
            at[t, :n] += _step(at[t - 1, :n], moves)
        for k, i in enumerate(block):
            out[i] = at[: lengths[k], k]
    return out


def _both_ways(scores: list[np.ndarray], moves: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Log odds from the lines up to each and from those from it on, its own emission in both."""
    fore = _odds(scores, moves)
    back = [x[::-1] for x in _odds([s[::-1] for s in scores], moves.T)]
    return fore, back


def _good(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def marginals(scores: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """P(good) of every line of every sequence."""
    return [_good(f + b - s) for f, b, s in zip(*_both_ways(scores, moves), scores)]


def objective(w: np.ndarray, moves: np.ndarray, stacked: np.ndarray, ends: np.ndarray, y: np.ndarray, per: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The objective and its gradients; ``y`` and ``per`` are the label and weight of each sequence."""
    scores = np.split(stacked @ w, ends[:-1])
    fore, back = _both_ways(scores, moves)
    sizes = np.diff(ends, prepend=0)
    of = np.repeat(np.arange(len(sizes)), sizes)
    s, f, b = (np.concatenate(x) for x in (scores, fore, back))
    slope = stacked.T @ ((y[of] - _good(f + b - s)) * per[of]) - RIDGE * w
    first = np.zeros(len(s), dtype=bool)
    first[ends - sizes] = True
    here, after = np.flatnonzero(~np.roll(first, -1)), np.flatnonzero(~first)
    logs = np.stack([np.broadcast_to(m, len(here)) + (i * f[here]) + (j * b[after]) for (i, j), m in np.ndenumerate(moves)], axis=1)
    top = logs.max(axis=1, keepdims=True)
    p = np.exp(logs - top)
    total = p.sum(axis=1, keepdims=True)
    of_pair = per[of[here]]
    expected = ((p / total) * of_pair[:, None]).sum(axis=0).reshape(2, 2)
    seen = np.zeros((2, 2))
    seen[0, 0], seen[1, 1] = (of_pair[y[of[here]] == 0]).sum(), (of_pair[y[of[here]] == 1]).sum()
    # log Z telescopes over the normalised steps: the first line's own, then each next line given those before
    start = np.logaddexp(0, s[first])
    next_good = np.logaddexp(moves[0, 1], moves[1, 1] + f[here]) + s[after]
    next_bad = np.logaddexp(moves[0, 0], moves[1, 0] + f[here])
    step = np.logaddexp(next_good, next_bad) - np.logaddexp(0, f[here])
    label = y[of[after]]
    own = (y * per) @ s[first] - per @ start + of_pair @ (label * s[after] + np.where(label == 1, moves[1, 1], moves[0, 0]) - step)
    value = own - RIDGE / 2 * (w @ w) - RIDGE_MOVES / 2 * (moves**2).sum()
    return float(value), slope, seen - expected - RIDGE_MOVES * moves


def fit(documents: list[list[np.ndarray]], lengths: list[list[np.ndarray]], labels: list[int]) -> Field:
    """Maximise the objective, then the logistic curve on the shares.

    A document is a list of runs, each a table of own features with its line lengths.
    """
    if len(set(labels)) < 2:
        return Field(np.zeros(0), np.zeros((2, 2)), constant=float(np.mean(labels)) if labels else 0.5)
    share = np.mean(labels)
    xs, y, per, of = [], [], [], []
    for i, (runs, label) in enumerate(zip(documents, labels)):
        size = sum(map(len, runs))
        for x in runs:
            xs.append(neighbours(x))
            y.append(label)
            per.append((0.5 / share if label else 0.5 / (1 - share)) / size)
            of.append(i)
    stacked, ends = np.vstack(xs).astype(np.float64), np.cumsum([len(x) for x in xs])
    y, per = np.array(y, dtype=float), np.array(per)
    w, moves = np.zeros(stacked.shape[1]), np.zeros((2, 2))
    value, slope, slope_m = objective(w, moves, stacked, ends, y, per)
    past_w, past_m, rate = np.zeros_like(w), np.zeros_like(moves), 1.0 / len(labels)
    for _ in range(ROUNDS):
        # momentum; a step that lowers the objective is taken back, and the next one is shorter
        step_w, step_m = 0.9 * past_w + rate * slope, 0.9 * past_m + rate * slope_m
        new = objective(w + step_w, moves + step_m, stacked, ends, y, per)
        if new[0] < value:
            past_w, past_m, rate = np.zeros_like(w), np.zeros_like(moves), rate / 2
            continue
        w, moves, past_w, past_m, rate = w + step_w, moves + step_m, step_w, step_m, rate * 1.1
        value, slope, slope_m = new
    field = Field(w, moves)
    good = marginals(np.split(stacked @ w, ends[:-1]), moves)
    sums, weights = np.zeros(len(labels)), np.zeros(len(labels))
    for g, n, i in zip(good, (n for runs in lengths for n in runs), of):
        sums[i] += g @ n
        weights[i] += n.sum()
    field.slope, field.offset = _curve(sums / weights, np.array(labels, dtype=float))
    return field


def runs_of(n: int, most: int) -> list[tuple[int, int]]:
    """Runs of lines that train, of ``n``: all, or ``most`` in ``RUNS`` runs spread over the whole."""
    if n <= most:
        return [(0, n)]
    count = min(RUNS, most)
    size = most // count
    return [(i * (n - size) // max(1, count - 1), i * (n - size) // max(1, count - 1) + size) for i in range(count)]


def _curve(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 4.0, -2.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        g = np.array([((y - p) * s).sum() - 0.01 * a, (y - p).sum() - 0.01 * b])
        v = p * (1 - p)
        h = np.array([[(v * s * s).sum() + 0.01, (v * s).sum()], [(v * s).sum(), v.sum() + 0.01]])
        d = np.linalg.solve(h, g)
        a, b = a + float(np.clip(d[0], -5, 5)), b + float(np.clip(d[1], -5, 5))
    return max(a, 1e-3), b


def held_out(ident: str = "doc_id"):
    """The fold that never trains: crc32 of the id as text, modulo ``FOLDS``, is 0."""
    return F.crc32(F.col(ident).cast("string").cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS, lines: int = SAMPLE_LINES) -> Field:
    """Fit on about ``rows`` labelled documents, those of lowest id hash outside the held-out fold."""
    marks = labels.where(F.col(label).isin(0, 1) & F.col(ident).isNotNull() & ~held_out(ident))
    marks = marks.groupBy(F.col(ident).alias("id")).agg(F.min(F.col(label).cast("int")).alias("y"))
    picked = saved(hashed_share(marks, F.col("id"), rows))

    @F.pandas_udf("starts array<int>, own binary, lengths binary")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch:
                split = t.split("\n")
                parts = [split[a:b] for a, b in runs_of(len(split), lines)]
                own = own_features([x for p in parts for x in p])
                size = np.array([len(x) + 1.0 for p in parts for x in p], dtype=np.float32)
                out.append((np.cumsum([len(p) for p in parts], dtype=np.int32), own.tobytes(), size.tobytes()))
            yield pd.DataFrame(out, columns=["starts", "own", "lengths"])

    texts = docs.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("t")).where("t is not null")
    # rows that repeat an id are told apart by their texts, so the choice doesn't depend on their order
    chosen = texts.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    found = chosen.select("id", "y", features("t").alias("x")).select("id", "y", "x.*").collect()
    found.sort(key=lambda r: r["id"])
    own = [np.split(np.frombuffer(r["own"], dtype=np.float32).reshape(-1, len(OWN)), r["starts"][:-1]) for r in found]
    sizes = [np.split(np.frombuffer(r["lengths"], dtype=np.float32), r["starts"][:-1]) for r in found]
    return fit(own, sizes, [r["y"] for r in found])


def score(docs: DataFrame, field: Field, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1; no shuffle."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [field.scores(batch.iloc[i : i + SLICE].tolist()) for i in range(0, len(batch), SLICE)]
            yield pd.Series(np.concatenate([np.empty(0), *parts]))

    return docs.withColumn(into, run(text_of(text)))
