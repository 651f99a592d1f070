"""Plain versions of the operators, and awkward rows for all of them."""

from __future__ import annotations

import hashlib
import re

import numpy as np

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kind string, spans int, __y string, row int"


def awkward(texts: list) -> list[tuple]:
    """Rows around ``texts``: nulls in any column, empty and very long texts, repeats, clashing columns."""
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "k", 1, "y", i) for i, t in enumerate(texts)]
    more = [None, "", " \n\t ", "word " * 30_000, "a" * 60_000, "é" * 50_000, "1 " * 20_000, "!" * 30_000, "\x00 ﻿ 🎉"]
    rows += [(1000 + i, t, None, None, None, None, None, None, None) for i, t in enumerate(more)]
    rows += [(None, "no id", "en", "s0", 5, "k", 1, "y", 0), (None, None, None, None, None, None, None, None, None)]
    return rows + [rows[0], rows[0], rows[-3]]


def luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def digits(m: str) -> str:
    return re.sub("[^0-9]", "", m)


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m[0])) <= 15),
}
SECRETS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 8),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
}


def base_spans(text: str | None, kinds: dict) -> tuple[list[int], str]:
    found = sorted((m.start(), i, k, m.end()) for i, (k, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text or "", re.A) if ok(m))
    return [sum(f[2] == k for f in found) for k in kinds], ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def classes(n: int, linked) -> list[int]:
    """Component of each of ``n`` items under a symmetric test of two indexes."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def top(ids: list, vectors: list, k: int, every: int) -> set:
    q = [None if v is None or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(256.0 * x)) for x in v] for v in vectors]
    out = set()
    for i, a in enumerate(q):
        if a is None or ids[i] is None or ids[i] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), ids[j] is None, ids[j] or 0, j) for j, b in enumerate(q) if b is not None and j != i and len(a) == len(b))
        out |= {(i, r + 1, ids[j], -s) for r, (s, _, _, j) in enumerate(scored[:k])}
    return out
