"""Regex matches with code point offsets, in DataFrame expressions only.

Spark's regex functions return texts, not places. ``split`` gives the gaps between the
matches that ``regexp_extract_all`` returns, so a match starts where the lengths of all
gaps and matches before it add up to. Running totals go through blocks of ``_STEP`` entries,
level over level, so their cost grows in proportion to the matches of a text; spans of
different kinds are set against each other in one sorted order. No row leaves its partition.

Spark may put the expression of a column in the place of its name, also where a lambda uses
it, and then evaluates it for every element. ``let`` binds a value that is evaluated once.

Patterns are Java regexes that must not match the empty string. They use possessive
loops and look-behinds where the plain form would retry every start within a long run.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP, _LEVELS, _PIECE = 16, 4, 256


def let(value: str, name: str, body: str) -> str:
    """SQL of ``body``, in which ``name`` stands for ``value``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _sum(a: str) -> str:
    return f"aggregate({a}, 0L, (p, q) -> p + q)"


def _max(a: str) -> str:
    return f"coalesce(array_max({a}), 0L)"


def running(values: str, most: bool = False) -> str:
    """SQL of the sums (or, with ``most``, the maxima from 0 on) of all entries before each of a bigint array."""
    total = _max if most else _sum
    both = (lambda a, b: f"greatest({a}, {b})") if most else (lambda a, b: f"{a} + {b}")
    upto = lambda a, i: total(f"slice({a}, cast({i} - {i} % {_STEP} as int) + 1, cast({i} % {_STEP} as int))")
    first = f"transform(v0, (x, i) -> {total('slice(v0, 1, i)')})"
    out = f"transform(v{_LEVELS}, (x, i) -> {total(f'slice(v{_LEVELS}, 1, i)')})"
    for k in range(_LEVELS - 1, -1, -1):
        out = let(out, f"t{k + 1}", f"transform(v{k}, (x, i) -> {both(f't{k + 1}[cast(i div {_STEP} as int)]', upto(f'v{k}', 'i'))})")
    for k in range(_LEVELS, 0, -1):
        below = f"v{k - 1}"
        out = let(f"transform(sequence(0, cast((size({below}) - 1) div {_STEP} as int)), b -> {total(f'slice({below}, b * {_STEP} + 1, {_STEP})')})", f"v{k}", out)
    return let(values, "v0", f"case when size(v0) <= {2 * _STEP} then {first} else {out} end")


def located(text: str, patterns: dict[str, str], context: int = 24) -> str:
    """SQL of an array of (kind, s, e, m, l, r) for all patterns in the text column, by pattern, then place.

    ``m`` is the match, ``l`` and ``r`` up to ``context`` characters beside it (cut at
    neighbouring matches of the same kind).
    """
    spans = []
    for kind, pattern in patterns.items():
        regex = quoted(pattern)
        gap = "length(g[i])"
        span = f"named_struct('kind', '{kind}', 's', at[i] + {gap}, 'e', at[i] + {gap} + length(m), 'm', m, 'l', right(g[i], {context}), 'r', left(g[i + 1], {context}))"
        starts = running(f"transform(ms, (m, i) -> cast({gap} + length(m) as bigint))")
        found = let(starts, "at", f"transform(ms, (m, i) -> {span})")
        spans.append(let(f"regexp_extract_all({text}, {regex}, 0)", "ms", let(f"case when size(ms) > 0 then split({text}, {regex}, -1) end", "g", found)))
    return f"concat({', '.join(spans)})"


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def apart(spans: str, fixed: str) -> str:
    """SQL of those of ``spans`` that overlap none of ``fixed``, both arrays with s and e, in their order."""
    entry = lambda kind: f"(x, i) -> named_struct('s', cast(x.s as bigint), 'e', cast(x.e as bigint), 'kind', {kind}, 'i', i)"
    ends = running("transform(o, x -> case when x.kind = 0 then x.e else 0L end)", most=True)
    # the next start is the greatest of the negated ones behind, shifted to stay above 0
    far = "(coalesce(array_max(transform(o, x -> x.e)), 0L) + 1)"
    starts = running("transform(reverse(o), x -> case when x.kind = 0 then far - x.s else 0L end)", most=True)
    free = "x.kind = 1 and upto[j] <= x.s and far - behind[size(o) - 1 - j] >= x.e"
    kept = f"array_sort(transform(filter(o, (x, j) -> {free}), x -> x.i))"
    out = let(ends, "upto", let(far, "far", let(starts, "behind", f"transform({kept}, i -> a[i])")))
    out = let(f"array_sort(concat(transform(f, {entry('0')}), transform(a, {entry('1')})))", "o", out)
    return let(spans, "a", let(fixed, "f", f"case when size(a) = 0 or size(f) = 0 then a else {out} end"))


def covered(spans: str) -> str:
    """SQL of the (s, e) between which no span lies before each cluster of overlapping ``spans``, in order."""
    ends = running("transform(o, x -> x.e)", most=True)
    gaps = "filter(transform(o, (x, i) -> named_struct('s', upto[i], 'e', x.s)), x -> x.e >= x.s)"
    return let(f"array_sort(transform({spans}, x -> named_struct('s', cast(x.s as bigint), 'e', cast(x.e as bigint))))", "o", let(ends, "upto", gaps))


def masked(text: str, spans: str, mark: str) -> str:
    """SQL of the text column with ``mark`` in the place of every cluster of overlapping ``spans``.

    The text is cut once into pieces of ``_PIECE`` code points, since a place far into a
    string takes a walk over all before it.
    """
    low, high = "greatest(x.s - k * {p}, 0L)", "least(x.e - k * {p}, {p}L)"
    part = f"substring(c[cast(k as int)], cast({low} as int) + 1, cast({high} - {low} as int))".format(p=_PIECE)
    piece = f"case when x.e > x.s then array_join(transform(sequence(x.s div {_PIECE}, (x.e - 1) div {_PIECE}), k -> {part}), '') else '' end"
    rest = "named_struct('s', array_max(transform(sp, x -> cast(x.e as bigint))), 'e', cast(length(t) as bigint))"
    whole = f"array_join(transform(concat({covered('sp')}, array({rest})), x -> {piece}), {quoted(mark)})"
    cut = let(f"regexp_extract_all(t, '(?s).{{1,{_PIECE}}}', 0)", "c", whole)
    return let(spans, "sp", let(text, "t", f"case when size(sp) = 0 then t else {cut} end"))


def joined(spans: str, order: list[str]) -> Column:
    """kind:start:end of an array column of spans by start, then kind in ``order``, comma-joined."""
    place = "array_position(array({}), x.kind)".format(", ".join(f"'{k}'" for k in order))
    return F.expr(f"array_join(transform(array_sort(transform({spans}, x -> named_struct('s', x.s, 'o', {place}, 'e', x.e, 'kind', x.kind))), x -> concat_ws(':', x.kind, x.s, x.e)), ',')")
