"""Personal data: labelers vote, expectation-maximisation weighs them, a classifier decides.

Candidates are the matches of the fixed kinds (valid or not) and of five looser shapes.
Four labelers vote yes, no or abstain on each: shape (the regex with its check digits and
ranges), gazetteer (top-level domains, card issuers, calling codes, first names, private
address ranges), context (cue words beside the span) and border (what touches the span).
A Dawid-Skene model, fitted by EM on the counts of vote patterns, estimates how reliable
each labeler is for each kind. Its posteriors train the final span classifier, a logistic
regression on kind, length, votes, and shape together with kind and with context. Spans of
the fixed kinds that pass their check are base spans and stay; the classifier adds others
that it puts at ``LEAST`` or more.

The counts have at most kinds x 3^4 x 3 rows, whatever the input; the models are fitted on
them by the driver and applied as column expressions. DataFrame and SQL functions only.
Null texts are empty; rows are handled one by one; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import packed, saved, text_of, unpacked, without
from ._spans import apart, joined, located

_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "other": "|".join(
        (
            r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,24}",
            r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
            r"(?<![0-9+)-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
            r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
            r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?",
        )
    ),
}
BASE = ["email", "ip", "card", "phone"]
LOOSE = ["masked_email", "id_number", "local_phone", "iban", "name"]
ORDER = [*BASE, *LOOSE]
LABELERS = ["shape", "gazetteer", "context", "border"]
#: What the classifier sees: one weight a value of each field.
FIELDS = ["kind", "size", *LABELERS, "kind+shape", "shape+context"]
LEAST = 0.9
#: Gazetteers.
DOMAINS = (
    "com org net edu gov mil int info biz name pro mobi asia io co ai app dev me tv cc xyz online site shop blog cloud tech"
    " de fr es uk eu ch at it nl be us ca mx br ar cl pe ve uy au nz za ng ke eg ma tn in pk bd lk cn hk tw jp kr sg my th vn id ph"
    " ru ua by kz pl cz sk hu ro bg gr tr il ae sa ir se no dk fi is ie pt lu li mt cy ee lv lt si hr rs ba mk al"
).split()
NAMES = (
    "james mary john anna robert linda michael maria david laura peter paul marie jean pierre hans klaus carlos jose ana"
    " william elizabeth richard susan thomas jessica charles sarah joseph karen christopher nancy daniel lisa matthew margaret anthony betty mark sandra"
    " steven emily andrew kimberly joshua donna kevin michelle brian carol george amanda edward melissa jason deborah ryan stephanie jacob rebecca"
    " alice emma olivia sophia lucas oliver henry samuel benjamin alexander max felix leon jonas lukas stefan andreas wolfgang juergen ursula"
    " monika petra sabine claudia julia lena louis jacques michel nicolas philippe claire camille sophie isabelle nathalie francois luis juan antonio"
    " manuel francisco miguel pedro javier carmen isabel lucia elena sofia pablo diego giovanni marco giulia francesca olga ivan natalia dmitri"
    " mohammed ahmed ali fatima omar hassan wei li ming yuki hiroshi kenji priya raj anil sunita"
).split()
CUES = {
    "email": "e-?mail|contact|write to|courriel|correo|kontakt",
    "ip": r"\bip\b|host|server|address|adresse",
    "card": "card|visa|mastercard|amex|carte|karte|tarjeta|credit",
    "phone": "tel|phone|call|mobile|fax|whatsapp",
    "masked_email": "e-?mail|contact|write to",
    "id_number": r"ssn|social security|\bid\b",
    "local_phone": "tel|phone|call|mobile|fax",
    "iban": "iban|account|konto|compte|cuenta",
    "name": "name|dear|contact|signed|author",
}
AGAINST = r"version|release|isbn|issn|serial|part no|order no|section|chapter"


def _kind(x: str) -> str:
    return (
        f"case when {x}.kind <> 'other' then {x}.kind when {x}.m rlike '[\\\\[(]at[\\\\])]' then 'masked_email'"
        f" when {x}.m rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then 'id_number' when {x}.m rlike '^[(0-9]' then 'local_phone'"
        f" when {x}.m rlike '^[A-Z]{{2}}[0-9]' then 'iban' else 'name' end"
    )


#: Luhn: from the right, every second digit is doubled and its own digits are added.
_LUHN = "aggregate(transform(split(reverse({d}), ''), (c, i) -> case when i % 2 = 0 then cast(c as int) else cast(c as int) * 2 div 10 + cast(c as int) * 2 % 10 end), 0, (p, q) -> p + cast(q as int)) % 10 = 0"
_DIGITS = "regexp_replace({m}, '[^0-9]', '')"
_PARTS = "forall(split({m}, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(p, 3)) as int) <= 255)"


def _shape(kind: str, m: str) -> str:
    d = _DIGITS.format(m=m)
    rem = f"aggregate(split(regexp_replace(concat(substring(regexp_replace({m}, ' ', ''), 5), left({m}, 4)), '[^A-Z0-9]', ''), ''), 0L, (p, c) -> case when c = '' then p when c rlike '[0-9]' then (p * 10 + cast(c as int)) % 97 else (p * 100 + ascii(c) - 55) % 97 end) = 1"
    return (
        f"case {kind} when 'email' then true when 'ip' then {_PARTS.format(m=m)}"
        f" when 'card' then case when length({d}) between 14 and 19 then {_LUHN.format(d=d)} else false end"
        f" when 'phone' then length({d}) between 10 and 15 when 'id_number' then not ({m} rlike '^(000|666|9)|-00-|-0000$')"
        f" when 'iban' then {rem} else true end"
    )


def _words(items: list[str]) -> str:
    return "(" + "|".join(items) + ")"


def _votes(x: str) -> dict[str, str]:
    """Labelers as SQL over a candidate ``x`` (kind, m, l, r, ok): 1 yes, 0 no, -1 abstain."""
    cue = " ".join(f"when '{k}' then lower({x}.l) rlike '{v.replace(chr(92), chr(92) * 2)}'" for k, v in CUES.items())
    d = _DIGITS.format(m=f"{x}.m")
    return {
        "shape": f"case when {x}.ok then 1 else 0 end",
        "gazetteer": (
            f"case {x}.kind when 'email' then case when lower({x}.m) rlike '[.]{_words(DOMAINS)}$' then 1 else 0 end"
            f" when 'masked_email' then case when lower({x}.m) rlike '[^a-z]{_words(DOMAINS)}$' then 1 else 0 end"
            f" when 'ip' then case when {x}.m rlike '^(0|127|255)[.]' then 0 else 1 end"
            f" when 'card' then case when {d} rlike '^(4|5[1-5]|2[2-7]|3[47]|6)' then 1 else 0 end"
            f" when 'phone' then case when {d} rlike '^(1|3[0-9]|4[0-9]|7|8[1246]|9[0-58])' then 1 else 0 end"
            f" when 'name' then case when lower({x}.m) rlike '[^a-z]{_words(NAMES)}([^a-z]|$)' then 1 else 0 end else -1 end"
        ),
        "context": f"case when lower({x}.l) rlike '{AGAINST}' then 0 when (case {x}.kind {cue} else false end) then 1 else -1 end",
        "border": f"case when {x}.l rlike '[A-Za-z0-9]$' or {x}.r rlike '^[A-Za-z0-9]' then 0 when {x}.l rlike '(^|[ (:\\\"])$' or {x}.l = '' then 1 else -1 end",
    }


def candidates(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``row`` (the ``keep`` columns), ``base`` spans and ``cand``: every candidate with its votes."""
    out = docs.select(packed(keep), text_of(text).alias("t")).select("row", F.expr(located("t", PATTERNS)).alias("every"))
    fields = "'s', x.s, 'e', x.e, 'm', x.m, 'l', x.l, 'r', x.r"
    out = out.withColumn("every", F.expr(f"transform(every, x -> named_struct('kind', {_kind('x')}, {fields}))"))
    out = out.withColumn("every", F.expr(f"transform(every, x -> named_struct('kind', x.kind, {fields}, 'ok', {_shape('x.kind', 'x.m')}))"))
    fixed = "x.kind in ({})".format(", ".join(f"'{k}'" for k in BASE))
    out = out.withColumn("base", F.expr(f"filter(every, x -> x.ok and {fixed})"))
    fresh = apart(f"filter(every, x -> not (x.ok and {fixed}) and (x.kind <> 'card' or length(x.m) >= 12))", "base")
    votes = ", ".join(f"'{k}', cast({v} as tinyint)" for k, v in _votes("x").items())
    size = "cast(case when length(x.m) < 10 then 0 when length(x.m) < 20 then 1 else 2 end as tinyint)"
    row = f"x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e, 'm', x.m, 'size', {size}, {votes})"
    return out.withColumn("cand", F.expr(f"transform(concat(base, {fresh}), {row})")).drop("every")


def train(found: DataFrame) -> dict[str, float]:
    """Reliabilities by EM, and the classifier's weights, from the counts of vote patterns."""
    rows = found.select(F.explode("cand").alias("x")).groupBy(*(F.col(f"x.{c}").alias(c) for c in ("kind", "size", *LABELERS))).agg(F.count("*").alias("n")).collect()
    patterns = [(r["kind"], r["size"], tuple(r[v] for v in LABELERS), r["n"]) for r in sorted(rows)]
    posterior = _em(patterns)
    return _logistic(patterns, posterior)


def _em(patterns: list, rounds: int = 50) -> dict[tuple, float]:
    """Dawid-Skene with abstention, a kind at a time; pseudo-counts favour labelers that are right."""
    out = {}
    by_kind = defaultdict(list)
    for kind, _, votes, n in patterns:
        by_kind[kind].append((votes, n))
    for kind, rows in by_kind.items():
        post = [0.9 if sum(v == 1 for v in votes) > sum(v == 0 for v in votes) else 0.1 for votes, _ in rows]
        for _ in range(rounds):
            total = sum(n for _, n in rows)
            prior = (sum(p * n for p, (_, n) in zip(post, rows)) + 1) / (total + 2)
            like = {}
            for j in range(len(LABELERS)):
                for truth in (0, 1):
                    mass = {v: {1: 8.0 if truth else 2.0, 0: 2.0 if truth else 8.0, -1: 5.0}[v] for v in (1, 0, -1)}
                    for p, (votes, n) in zip(post, rows):
                        mass[votes[j]] += n * (p if truth else 1 - p)
                    s = sum(mass.values())
                    like[j, truth] = {v: m / s for v, m in mass.items()}
            new = []
            for votes, _ in rows:
                a, b = math.log(prior), math.log(1 - prior)
                for j, v in enumerate(votes):
                    a, b = a + math.log(like[j, 1][v]), b + math.log(like[j, 0][v])
                new.append(1 / (1 + math.exp(max(-500.0, min(500.0, b - a)))))
            post = new
        out |= {(kind, votes): p for (votes, _), p in zip(rows, post)}
    return out


def _features(kind: str, size: int, votes: tuple) -> list[str]:
    value = {"kind": kind, "size": size} | dict(zip(LABELERS, votes))
    return ["bias", *(f"{field}:{'/'.join(str(value[f]) for f in field.split('+'))}" for field in FIELDS)]


def _logistic(patterns: list, posterior: dict, rounds: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> dict[str, float]:
    weights = {name: 0.0 for k, s, v, _ in patterns for name in _features(k, s, v)}
    total = sum(n for *_, n in patterns) or 1
    share = [math.sqrt(n / total) for *_, n in patterns]
    norm = sum(share) or 1
    for _ in range(rounds):
        slope = {k: ridge * w for k, w in weights.items()}
        for (kind, size, votes, _), s in zip(patterns, share):
            names = _features(kind, size, votes)
            p = 1 / (1 + math.exp(-sum(weights[f] for f in names)))
            for f in names:
                slope[f] += s / norm * (p - posterior[kind, votes])
        for f, g in slope.items():
            weights[f] -= rate * g * 4
    return {k: round(w, 6) for k, w in weights.items()}


def decide(found: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``found`` with ``spans``: base spans and what the classifier adds, each with its probability."""
    parts = [f"{weights.get('bias', 0.0)}D"]
    for field in FIELDS:
        own = {k.split(":", 1)[1]: w for k, w in weights.items() if k.startswith(field + ":")}
        if own:
            value = "concat_ws('/', " + ", ".join(f"cast(x.{f} as string)" for f in field.split("+")) + ")"
            parts.append(f"case {value} " + " ".join(f"when '{v}' then {w}D" for v, w in sorted(own.items())) + " else 0D end")
    p = f"1D / (1D + exp(-({' + '.join(parts)})))"
    out = found.withColumn("scored", F.expr(f"transform(cand, x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e, 'm', x.m, 'p', {p}))"))
    added = f"filter(scored, (x, i) -> i >= size(base) and x.p >= {LEAST}D)"
    return out.withColumn("spans", F.expr(f"concat(slice(scored, 1, size(base)), {added})")).drop("scored")


def spans(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns with counts, the joined base and all spans, and the spans themselves.

    Columns to keep that are named like one of these give way to it.
    """
    keep = without(keep, [*(f"n_{k}" for k in BASE), "base", "spans", "found"])
    found = saved(candidates(docs, keep, text))
    out = decide(found, train(found))
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)")
    return out.select(*unpacked(keep), *(count(k).alias(f"n_{k}") for k in BASE), joined("base", BASE).alias("base"), joined("spans", ORDER).alias("spans"), F.col("spans").alias("found"))
