"""License scan: Aho-Corasick over normalised words, expressions by shunting-yard.

A text is lower-cased (A-Z) and cut into words, joined by single spaces; one automaton
then finds every phrase in a single pass. Where an identifier tag stands, the expression
behind it, as far as it is well formed, is parsed into postfix form and evaluated: OR
takes the freer side, AND the stricter, WITH lifts a copyleft licence by its exception.

Nulls are read as empty. A text without words has no places, null ends, empty labels and
the neutral score 0.5. Repeated rows are scanned each on its own. Whole texts are read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ._common import text_of

#: Phrases whose places are counted, with their labels (fixed values of the contract).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases that the method adds.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license": "apache-2.0",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl-2.0",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "boost software license": "bsl-1.0",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0-1.0",
    "public domain dedication": "cc0-1.0",
    "released into the public domain": "cc0-1.0",
    "gnu gpl": "gpl",
    "gnu lgpl": "lgpl",
    "gnu agpl": "agpl",
    "gnu library general public license": "lgpl",
    "free documentation license": "gfdl",
    "gnu fdl": "gfdl",
    "licensed under the apache license version 2 0": "apache-2.0",
    "subject to the terms of the mozilla public license": "mpl-2.0",
    "common development and distribution license": "cddl",
    "common public license": "cpl",
    "european union public licence": "eupl",
    "artistic license": "artistic",
    "python software foundation license": "psf",
    "academic free license": "afl",
    "open software license": "osl",
    "microsoft public license": "ms-pl",
    "zlib license": "zlib",
    "the unlicense": "unlicense",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "universal permissive license": "upl",
    "blue oak model license": "blueoak",
    "open data commons attribution": "odc-by",
    "open database license": "odbl",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0-1.0",
    "server side public license": "sspl",
    "business source license": "busl",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "neither the name of the copyright holder nor the names of its contributors": "bsd",
    "no part of this publication may be reproduced": "reserved",
    "reproduction without permission is prohibited": "reserved",
    "proprietary and confidential": "proprietary",
}
TAG = "spdx license identifier"
#: How freely a text under each family may be reused, 0 to 1.
FREEDOM = {"mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "cc0": 1.0, "unlicense": 1.0, "zlib": 1.0, "cc-by": 0.9, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "gpl": 0.4, "agpl": 0.3, "reserved": 0.0, "proprietary": 0.0} | {
    "cc-by-sa": 0.6, "cc-by-nc": 0.3, "cc-by-nd": 0.2, "odc-by": 0.9, "odbl": 0.6, "gfdl": 0.5, "psf": 1.0, "artistic": 0.9, "upl": 1.0, "blueoak": 1.0, "ms-pl": 0.9, "afl": 0.9,
    "eupl": 0.5, "cddl": 0.7, "cpl": 0.7, "osl": 0.4, "sspl": 0.2, "busl": 0.1,
}
NEUTRAL, EXCEPTION = 0.5, 0.3
_TAG_LINE = re.compile(r"spdx-license-identifier[ \t]*:?[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_RANK = {"or": 1, "and": 2, "with": 3}

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SCHEMA = StructType(
    [StructField(n, LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
    + [StructField(n, StringType()) for n in ("base_labels", "labels", "expression")]
    + [StructField("score", DoubleType())]
)


_FAMILIES = sorted(FREEDOM, key=len, reverse=True)


@functools.lru_cache(4096)
def freedom(label: str) -> float:
    for family in _FAMILIES:
        if label == family or label.startswith(family + "-"):
            return FREEDOM[family]
    return NEUTRAL


def postfix(expression: str) -> list[str]:
    """Shunting-yard; WITH binds before AND before OR, all from the left. ValueError if malformed."""
    out, stack, operand = [], [], False
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if word in _RANK:
            if not operand:
                raise ValueError(f"operator without left side: {expression!r}")
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = False
        elif token == "(":
            if operand:
                raise ValueError(f"bracket after a name: {expression!r}")
            stack.append(token)
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack or not operand:
                raise ValueError(f"unbalanced: {expression!r}")
            stack.pop()
        else:
            if operand:
                raise ValueError(f"two names in a row: {expression!r}")
            out.append(word)
            operand = True
    while stack:
        if stack[-1] == "(":
            raise ValueError(f"unbalanced: {expression!r}")
        out.append(stack.pop())
    if not out or not operand:
        raise ValueError(f"no operand at the end: {expression!r}")
    return out


def leading(line: str) -> str:
    """The longest well-formed expression at the start of ``line``, up to a sentence's end; empty if there is none."""
    parts, whole, depth, operand = [], 0, 0, False
    for found in _TOKEN.finditer(line):
        token = found[0]
        name, rank = token.rstrip(".:-"), token.lower() in _RANK
        if rank or token == ")":
            if not operand or (token == ")" and not depth):
                break
        elif operand or not name:
            break
        parts.append(name)
        depth += (token == "(") - (token == ")")
        operand = not rank and token != "("
        if operand and not depth:
            whole = len(parts)
        if "." in token[len(name) :]:
            break
    return " ".join(parts[:whole])


def evaluate(expression: str) -> tuple[float, list[str]]:
    """Freedom of an expression and the licences it names."""
    stack, names = [], []
    for token in postfix(expression):
        if token not in _RANK:
            stack.append((freedom(token), token))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            names.append(left[1])
            stack.append((min(1.0, left[0] + EXCEPTION), None))
            continue
        names += [x[1] for x in (left, right) if x[1]]
        stack.append(((max if token == "or" else min)(left[0], right[0]), None))
    value, last = stack.pop()
    return value, list(dict.fromkeys([*names, *([last] if last else [])]))


class Scanner:
    def __init__(self):
        self.auto = ahocorasick.Automaton()
        for phrase in {**NOTICES, **BASE, TAG: ""}:
            self.auto.add_word(f" {phrase} ", phrase)
        self.auto.make_automaton()

    def scan(self, text: str) -> tuple:
        words = text.encode().translate(_WORDS).split()
        flat = " " + b" ".join(words).decode() + " "
        first = last = None
        n_base, base, labels, tagged = 0, set(), set(), False
        done = passed = 0  # words that end before the place reached; matches come by their ends
        for end, phrase in self.auto.iter(flat):
            if phrase in BASE:
                passed, done = passed + flat.count(" ", done, end), end
                at = passed - 1 - phrase.count(" ")
                n_base += 1
                first, last = (at, at) if first is None else (min(first, at), max(last, at))
                base.add(BASE[phrase])
            tagged |= phrase == TAG
            labels.add(NOTICES.get(phrase, ""))
        labels = (labels | base) - {""}
        values, expressions = [freedom(x) for x in labels], []
        for found in _TAG_LINE.finditer(text) if tagged else ():
            if expression := leading(found[1]):
                value, names = evaluate(expression)
                values.append(value)
                labels.update(filter(None, names))
                expressions.append(" ".join(postfix(expression)))
        score = min(values) if values else NEUTRAL
        return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), "; ".join(expressions), score


def scan(docs: DataFrame, text: str = "text", into: str = "licence") -> DataFrame:
    """``docs`` with a struct of the scan's findings; no shuffle."""

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        for batch in batches:
            rows = pd.DataFrame([scanner.scan(t) for t in batch], columns=SCHEMA.names)
            yield rows.astype({n: "Int64" for n in ("n_words", "n_base", "first_word", "last_word")})

    return docs.withColumn(into, run(text_of(text)))
