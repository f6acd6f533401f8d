"""Personal data by weak supervision, in DataFrame functions only.

Candidates are all base matches (strict patterns) and wider ones that no base match of the same kind overlaps. Four
labelers vote on each: the strict pattern, a gazetteer, the words just before it and its shape. Expectation-maximisation over
the counts of vote patterns estimates each labeler's reliability without labels; its posteriors train the final span
classifier, a logistic regression. Counts go to the driver as one row for each pattern of votes and features, of which there
are 5 * 3^4 * 2^2 at most, however large the corpus is. Base matches always stay; wide ones stay if the classifier says so.
Secrets (keys and tokens) are a kind with wide candidates only, which the labelers alone decide on; they are reported apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

# Kinds in their order, and their base patterns, made linear by possessive repeats and a look at what is before.
KINDS = ("email", "ip", "card", "phone")
EVERY = (*KINDS, "secret")
BASE = {
    "email": r"(?=[A-Za-z0-9._%+-])(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?=[A-Za-z0-9._%+-])(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9.])[0-9]{1,3}+\[\.\][0-9]{1,3}+\[\.\][0-9]{1,3}+\[\.\][0-9]{1,3}+(?![0-9])",
    "card": r"(?=[0-9])(?<![0-9.])[0-9]{4}+[./_][0-9]{4}+[./_][0-9]{4}+[./_][0-9]{4}+(?![0-9])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9][A-Za-z0-9+/_=-]{7})(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{16,}+",
}
#: A row goes through a pattern only if it has this; each is a plain test.
NEEDS = {
    "email": (lambda t: F.contains(t, F.lit("@")), lambda t: t.rlike(r"(?:\(|\[)(?:at|AT)")),
    "ip": (lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda t: F.contains(t, F.lit("[.]"))),
    "card": (lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), lambda t: t.rlike(r"[0-9]{4}[./_][0-9]{4}")),
    "phone": (lambda t: F.contains(t, F.lit("+")), lambda t: t.rlike(r"[0-9]{3}[).-]")),
    "secret": (None, lambda t: t.rlike(r"[0-9][A-Za-z0-9+/_=-]{7}")),
}
CUES = {
    "email": r"(?i)mail|contact|write|address|from|to:|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|host|server|addr|login|client|from",
    "card": r"(?i)card|visa|master|amex|credit|debit|pay|karte|carte|tarjeta",
    "phone": r"(?i)phone|tel|call|fax|mobile|cell|ring|contact|anruf|ll[aá]m|appel",
    "secret": r"(?i)token|secret|key|passw|pwd|bearer|auth|credential|clave|schl[uü]ssel|jeton",
}
COUNTER = r"(?i)version|isbn|issn|\bv\.?\s?$|build|release|order|ticket|serial|token|section|chapter|page|doi"
TOP_LEVELS = "com|org|net|edu|gov|io|co|uk|de|fr|es|it|eu|us|info|biz|example|test"

_SPAN = "array<struct<kind:int,start:bigint,stop:bigint,wide:boolean,valid:boolean,v0:int,v1:int,v2:int,v3:int,f0:int,f1:int>>"
_CHUNK = 1000


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            F.substring(digits, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(digits, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)),
    )
    return total % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    """Does a base match pass what the pattern can't say?"""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
            F.split(found, r"\."), lambda p: F.coalesce(F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int"), F.lit(0)) <= 255
        )
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15)


def _running(sizes: Column) -> Column:
    """Sums of all elements before each, in blocks, so that an array of n costs about n * _CHUNK steps at most."""
    count = F.size(sizes)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((count - 1) / _CHUNK).cast("int")), lambda b: F.slice(sizes, b * _CHUNK + 1, F.lit(_CHUNK)))
    empty = F.lit([]).cast("array<bigint>")

    def before(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("s"), empty.alias("a"))
        return F.aggregate(values, first, lambda acc, x: F.struct((acc.s + x).alias("s"), F.concat(acc.a, F.array(acc.s)).alias("a")), lambda acc: acc.a)

    totals = before(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda acc, x: acc + x)), F.lit(0).cast("bigint"))
    return F.flatten(F.transform(blocks, lambda b, i: before(b, totals[i])))


def _gazetteer(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "email":
        return F.when(F.lower(found).rlike(rf"(?:\.|dot[\])]\s?)(?:{TOP_LEVELS})$"), 1).otherwise(-1)
    if kind == "ip":
        return F.when(found.rlike(r"^(?:0|22[4-9]|2[3-9][0-9])[.\[]"), -1).otherwise(1)
    if kind == "card":
        return F.when(digits.rlike("^[3-6]"), 1).otherwise(-1)
    if kind == "secret":  # known beginnings and lengths; few different characters speak against it
        some = F.size(F.array_distinct(F.split(F.lower(found), "")))
        return F.when(found.rlike(r"^(?:AKIA|gh[pos]_|sk-|xox[bp]-|eyJ)|^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"), 1).when(some < 9, -1).otherwise(0)
    return F.when(digits.rlike("^(?:1|3[0-9]|4[0-9]|[2-9])"), 1).otherwise(-1)


def _span(kind: str, wide: bool, before: Column, start: Column, match: Column) -> Column:
    """A candidate with its votes and features; before: the text since the match before it, start: its place."""
    around = F.right(before, F.lit(24))
    digits = F.regexp_replace(match, "[^0-9]", "")
    shape = F.when(digits.rlike(r"^(\d)\1*$|^0?123456789?0?$"), -1).when(match.rlike(r"[\x20().-]"), 1).otherwise(0)
    if kind == "secret":  # digits all through it, not a word with a number or a path
        shape = F.when(match.rlike(r"[A-Za-z]{14}|(?:/.*){3}|(?:_.*){4}|(?:-.*){5}"), -1).when(F.length(digits) >= 5, 1).otherwise(0)
    begin = start + F.length(before)
    return F.struct(
        F.lit(EVERY.index(kind)).alias("kind"), begin.alias("start"), (begin + F.length(match)).alias("stop"),
        F.lit(wide).alias("wide"), (F.lit(True) if wide else _valid(kind, match)).alias("valid"),
        F.lit(0 if wide else 1).alias("v0"), _gazetteer(kind, match).alias("v1"),
        F.when(around.rlike(CUES[kind]), 1).when(around.rlike(COUNTER), -1).otherwise(0).alias("v2"), shape.alias("v3"),
        F.when(around.rlike(r"[\s:]$|^$"), 1).otherwise(0).alias("f0"), F.when(F.length(match) >= 12, 1).otherwise(0).alias("f1"),
    )


def _spanner(kind: str, wide: bool) -> Callable[[Column], Column]:
    return lambda x: _span(kind, wide, x["p"], x["s"], x["m"])


def _of_kind(number: int) -> Callable[[Column], Column]:
    return lambda s: s.kind == number


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, wide: arrays of candidate spans in code points; a null text counts as empty.

    Matches, the pieces between them and their running lengths are columns of their own, each computed once and only where there
    is a match.
    """
    out = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    every = [(f"{k}_{int(wide)}", k, wide, (WIDE if wide else BASE)[k]) for wide in (False, True) for k in (EVERY if wide else KINDS)]
    some = lambda name, then, kind: F.when(F.size(f"m_{name}") > 0, then).otherwise(F.lit([]).cast(kind))
    text = F.col("text")
    out = out.withColumns({f"m_{n}": F.when(NEEDS[k][int(wide)](text), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(F.lit([]).cast("array<string>")) for n, k, wide, p in every})
    out = out.withColumns({f"p_{n}": some(n, F.split(text, p, -1), "array<string>") for n, _, _, p in every}).drop("text")
    out = out.withColumns({f"l_{n}": some(n, F.zip_with(F.slice(f"p_{n}", F.lit(1), F.size(f"m_{n}")), f"m_{n}", lambda p, m: (F.length(p) + F.length(m)).cast("bigint")), "array<bigint>") for n, *_ in every})
    out = out.withColumns({f"s_{n}": some(n, _running(F.col(f"l_{n}")), "array<bigint>") for n, *_ in every})
    spans = {}
    for n, k, wide, _ in every:
        parts = F.arrays_zip(F.slice(f"p_{n}", F.lit(1), F.size(f"m_{n}")).alias("p"), F.col(f"s_{n}").alias("s"), F.col(f"m_{n}").alias("m"))
        found = F.filter(F.transform(parts, _spanner(k, wide)), lambda s: s.valid)
        spans[f"x_{n}"] = some(n, found.cast(_SPAN), _SPAN)
    out = out.withColumns(spans)
    both = out.select("doc_id", F.concat(*[f"x_{k}_0" for k in KINDS]).alias("base"), F.concat(*[f"x_{k}_1" for k in EVERY]).alias("wide"))
    free = F.filter("wide", lambda w: ~F.exists("base", lambda b: (b.kind == w.kind) & (b.start < w.stop) & (w.start < b.stop)))
    ordered = F.when(F.size("base") > 1, F.array_sort("base", _order)).otherwise(F.col("base"))
    return both.select("doc_id", ordered.alias("base"), F.when(F.size("wide") > 0, free).otherwise(F.col("wide")).alias("wide"))


def _order(a: Column, b: Column) -> Column:
    key = lambda s: s.start * len(EVERY) + s.kind
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def reliabilities(rows: list[tuple[int, list[int]]], rounds: int = 40) -> tuple[list[dict], list[float], float]:
    """(for each labeler: vote -> its probability on true and on false spans; the posterior of each row; the share of true spans).

    rows: (how many, votes). Expectation-maximisation for independent labelers, from the majority vote, with one count added for each vote.
    """
    posterior = [0.9 if sum(v) > 0 else 0.1 for _, v in rows]
    says, prior = [], 0.5
    for _ in range(rounds):
        yes, no = sum(n * p for (n, _), p in zip(rows, posterior)), sum(n * (1 - p) for (n, _), p in zip(rows, posterior))
        prior = (yes + 1) / (yes + no + 2)
        says = [
            {c: ((sum(n * p for (n, v), p in zip(rows, posterior) if v[j] == c) + 1) / (yes + 3), (sum(n * (1 - p) for (n, v), p in zip(rows, posterior) if v[j] == c) + 1) / (no + 3)) for c in (-1, 0, 1)}
            for j in range(len(rows[0][1]))
        ]
        for i, (_, v) in enumerate(rows):
            a = prior * math.prod(says[j][c][0] for j, c in enumerate(v))
            b = (1 - prior) * math.prod(says[j][c][1] for j, c in enumerate(v))
            posterior[i] = a / (a + b)
    return says, posterior, prior


def fit(spans: DataFrame, rounds: int = 40) -> dict[str, list[float]]:
    """Weights of the final classifier by kind: bias, four votes, two features.

    First the reliabilities: for each labeler the probability of voting yes, no or not at all on true and on false spans,
    from the counts of vote patterns by expectation-maximisation, started from the majority vote. Then a logistic
    regression on votes and features that fits the posteriors. A kind without candidates gets a bias of -1 only.
    """
    votes, features = ["v0", "v1", "v2", "v3"], ["f0", "f1"]
    every = spans.select(F.explode(F.concat("base", "wide")).alias("s")).select("s.*")
    table = every.groupBy("kind", *votes, *features).agg(F.count(F.lit(1)).alias("n")).orderBy("kind", *votes, *features).collect()
    out = {}
    for k, kind in enumerate(EVERY):
        rows = [(r["n"], [r[v] for v in votes], [float(r[f]) for f in features]) for r in table if r["kind"] == k]
        if not rows:
            out[kind] = [-1.0] + [0.0] * 6
            continue
        posterior = reliabilities([(n, v) for n, v, _ in rows], rounds)[1]
        weights, total = [0.0] * 7, sum(n for n, _, _ in rows)
        for _ in range(300):
            slope = [0.01 * w for w in weights]
            for (n, v, f), p in zip(rows, posterior):
                x = [1.0, *map(float, v), *f]
                miss = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(weights, x)))))) - p
                slope = [s + n / total * miss * a for s, a in zip(slope, x)]
            weights = [w - s for w, s in zip(weights, slope)]
        out[kind] = weights
    return out


def score(weights: dict[str, list[float]], span: Column) -> Column:
    """The classifier's probability for a span, as an expression."""
    names = ("v0", "v1", "v2", "v3", "f0", "f1")
    parts = [reduce(lambda a, b: a + b, (span[n] * w for n, w in zip(names, weights[k][1:])), F.lit(weights[k][0])) for k in EVERY]
    total = F.lit(None).cast("double")
    for k, part in enumerate(parts):
        total = F.when(span.kind == k, part).otherwise(total)
    return 1 / (1 + F.exp(-total))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.5) -> DataFrame:
    """doc_id, base, spans, secrets: per row of ``docs`` the base spans, these with the wide ones that the classifier accepts, and the secrets it accepts.

    Spans are ordered by start, then by kind; starts count code points and stops are exclusive; p is the classifier's probability. Null and empty texts have
    none. Repeated rows give repeated results; a null id stays null; other columns are ignored.
    """
    found = written(candidates(docs, id_col, text_col))
    weights = fit(found)
    secret = EVERY.index("secret")
    rated = lambda spans: F.when(F.size(spans) > 0, F.transform(spans, lambda s: s.withField("p", score(weights, s)))).otherwise(F.lit([]).cast(_SPAN.replace(">>", ",p:double>>")))
    both = found.select("doc_id", rated(F.col("base")).alias("base"), F.filter(rated(F.col("wide")), lambda s: s.p >= accept).alias("good"))
    more = F.filter("good", lambda s: s.kind != secret)
    spans = F.when(F.size(more) > 0, F.array_sort(F.concat("base", more), _order)).otherwise(F.col("base"))
    return both.select("doc_id", "base", spans.alias("spans"), F.array_sort(F.filter("good", lambda s: s.kind == secret), _order).alias("secrets"))


def written_out(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    names = F.array(*[F.lit(k) for k in EVERY])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s.kind], s.start.cast("string"), s.stop.cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, then n_secret, secrets (as spans) and confidence: the least probability of an added span or secret, null without any.

    spans holds all spans, those of secrets too, by start, then kind, secrets last. Null texts are empty, so their counts are 0 and their spans the empty text; a null
    id stays null, repeated rows have repeated results, an empty table has none, and other columns are ignored.
    """
    found = find(docs)
    every = F.when(F.size("secrets") > 0, F.array_sort(F.concat("spans", "secrets"), _order)).otherwise(F.col("spans"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    added = F.array_min(F.transform(F.concat(F.filter("spans", lambda s: s.wide), F.col("secrets")), lambda s: s.p))
    return found.select(
        "doc_id", *counts, F.sha2(written_out(F.col("base")), 256).alias("base_sha256"), written_out(every).alias("spans"),
        F.size("secrets").cast("bigint").alias("n_secret"), written_out(F.col("secrets")).alias("secrets"), F.round(added, 6).alias("confidence"),
    )
