"""Equivalence and refinement of expression pairs over a domain of inputs: one plan for any number of rules.

Both sides are evaluated in one row, each over columns of its own that hold the same inputs: the second ones went through text, so
the optimizer can't know that they are equal and take one side for the other. A verdict is one aggregate, combined where
the inputs are; nothing but verdicts is shuffled. It carries the smallest witness and says whether the source side is
defined anywhere.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.words import DUCKDB, SPARK, Dialect
from .expression import compiled, renamed, undefined


class Rule(NamedTuple):
    """before may become after: equal where before is defined, if ``refines``; else equal everywhere, poison included.

    ``ub``: division is undefined where instructions have it so, shifts by the width are poison; where before is undefined, anything is allowed.
    """

    name: str
    before: object
    after: object
    refines: bool = True
    assume: str = "true"
    ub: bool = False


_COPY = "__"  # suffix of the second columns
_AT_ONCE = 4  # rules in one aggregate: more make its code too long to be compiled


def exhaustive(spark: SparkSession, width: int, names: tuple[str, ...] = ("x", "y"), poison: tuple[str, ...] = (), ids: DataFrame | None = None) -> DataFrame:
    """All assignments of the variables, one row each, cut from one counter; n says how often each counts. ``poison``: variables that have a poison bit, too.

    ``ids``: of the counter, only these, each once.
    """
    ids = spark.range(2 ** (width * len(names) + len(poison))) if ids is None else ids
    bits = [F.expr(f"(shiftright(id, {width * len(names) + i}) & 1) = 1").alias(f"{p}_poison") for i, p in enumerate(poison)]
    return ids.select(*[F.expr(f"shiftright(id, {width * i}) & {2**width - 1}").alias(n) for i, n in enumerate(names)], *bits, F.lit(1).cast("bigint").alias("n"))


def whole(ids: DataFrame, width: int, names: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """All assignments of the variables, each with n = 1 and met = 0, and those that rows of a table stand for, with n = 0 and met, the number of these rows.

    ids: a row's number on the counter of assignments.
    """
    cut = [F.expr(f"shiftright(id, {width * i}) & {2**width - 1}").alias(n) for i, n in enumerate(names)]
    return counted(ids, 2 ** (width * len(names))).select(*cut, "n", "met")


def counted(ids: DataFrame, size: int) -> DataFrame:
    """id, n, met: the counter below ``size`` with n = 1 and met = 0, and the numbers of a table's rows with n = 0 and how many rows have them."""
    rows = ids.groupBy("id").agg(F.lit(0).cast("bigint").alias("n"), F.count(F.lit(1)).alias("met"))
    return ids.sparkSession.range(size).select("id", F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("met")).unionByName(rows)


def observed(rows: DataFrame, names: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """The assignments that a table holds, each once, and how often: a rule is evaluated once for equal inputs."""
    return rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def _judged(rule: Rule, width: int, dialect: Dialect, poison: frozenset[str], suffix: str) -> tuple[str, str]:
    """SQL texts: is before defined, and is the rule violated? ``suffix``: of the variables of after."""
    after = renamed(rule.after, suffix) if suffix else rule.after
    poison_after = frozenset(p + suffix for p in poison)
    (vb, pb, _), (va, pa, _) = compiled(rule.before, width, dialect, poison, rule.ub), compiled(after, width, dialect, poison_after, rule.ub)
    if not rule.refines:
        return f"not ({pb})", f"(({vb}) <> ({va}) or ({pb}) <> ({pa}))"
    wrong = f"(not ({pb}) and (({pa}) or ({vb}) <> ({va})))"
    if not rule.ub:
        return f"not ({pb})", wrong
    ub, ua = undefined(rule.before, width, dialect, poison, True), undefined(after, width, dialect, poison_after, True)
    return f"(not ({ub}) and not ({pb}))", f"(not ({ub}) and (({ua}) or {wrong}))"


def verdicts(domain: DataFrame, rules: list[Rule], width: int, names: tuple[str, ...] = ("x", "y"), poison: tuple[str, ...] = (), drawn: bool = False, met: bool = False) -> DataFrame:
    """rule, rows_checked, defined, violations, witness_<name>, status: one row per rule. domain: the variables, distinct, their poison bits, and n.

    ``met``: the domain is that of ``whole``; two more columns, rows_met and violations_met, say how many rows of the table a rule is checked on and violated by.
    ``drawn``: the domain may lack assignments; rules without a violation are then bounded-proved only if it lacks none, else sampled-agree.
    """
    if width * len(names) > 62:
        raise ValueError("a witness has 62 bits at most")
    held = frozenset(poison)
    copies = [F.expr(f"cast(cast({n} as string) as bigint)").alias(n + _COPY) for n in names] + [F.expr(f"cast(cast({p}_poison as string) as boolean)").alias(f"{p}{_COPY}_poison") for p in poison]
    both = domain.select("*", *copies)
    at = " + ".join(f"{n} * {2 ** (width * (len(names) - 1 - i))}" for i, n in enumerate(names))
    out = None
    for k in range(0, len(rules), _AT_ONCE):
        sums, rows = [], []
        for i, r in enumerate(rules[k : k + _AT_ONCE]):
            defined, bad = _judged(r, width, SPARK, held, _COPY)
            for name, test in (("ok", r.assume), ("fine", f"({r.assume}) and {defined}"), ("bad", f"({r.assume}) and {bad}")):
                sums.append(F.expr(f"coalesce(sum(case when {test} then n else 0 end), 0)").alias(f"{name}{i}"))
            for name, test in (("met", r.assume), ("hit", f"({r.assume}) and {bad}")) if met else ():
                sums.append(F.expr(f"coalesce(sum(case when {test} then met else 0 end), 0)").alias(f"{name}{i}"))
            sums.append(F.expr(f"min(case when ({r.assume}) and {bad} then {at} end)").alias(f"at{i}"))
            rows.append(F.struct(F.lit(r.name).alias("rule"), F.col(f"ok{i}").alias("rows_checked"), F.col(f"fine{i}").alias("defined"), F.col(f"bad{i}").alias("violations"), F.col(f"at{i}").alias("at"), *([F.col(f"met{i}").alias("rows_met"), F.col(f"hit{i}").alias("violations_met")] if met else [])))
        part = both.agg(*sums, F.count(F.lit(1)).alias("every")).select("every", F.inline(F.array(*rows)))
        out = part if out is None else out.unionByName(part)
    whole = F.col("every") == 2 ** (width * len(names) + len(poison)) if drawn else F.lit(True)
    status = F.when(F.col("rows_checked") == 0, "vacuous").when(F.col("violations") > 0, "refuted").when(F.col("defined") == 0, "vacuous").when(whole, f"bounded-proved@{width}").otherwise("sampled-agree")
    witness = [F.expr(f"shiftright(at, {width * (len(names) - 1 - i)}) & {2**width - 1}").alias(f"witness_{n}") for i, n in enumerate(names)]
    return out.select("rule", "rows_checked", "defined", "violations", *witness, *(["rows_met", "violations_met"] if met else []), status.alias("status"))


def verdicts_sql(domain: str, rules: list[Rule], width: int, names: tuple[str, ...] = ("x", "y"), poison: tuple[str, ...] = (), drawn: bool = False, met: bool = False) -> str:
    """The same in DuckDB's SQL over a subquery that has the variables and their poison bits; with ``met``, n and met, too."""
    parts, more = [], ", n, met" if met else ""
    count = (lambda test, of="n": f"coalesce(sum({of}) filter ({test}), 0)::BIGINT") if met else (lambda test, of="": f"count(*) filter ({test})")
    for r in rules:
        defined, bad = _judged(r, width, DUCKDB, frozenset(poison), "")
        parts.append(f"select '{r.name}' as rule, {', '.join(names)}, ({r.assume}) as ok, {defined} as fine, {bad} as bad{more} from d")
    witness = ", ".join(f"(min(({', '.join(names)})) filter (ok and bad))[{i + 1}] as witness_{n}" for i, n in enumerate(names))
    witness += f", {count('ok', 'met')} as rows_met, {count('ok and bad', 'met')} as violations_met" if met else ""
    whole = f"every = {2 ** (width * len(names) + len(poison))}" if drawn else "true"
    return f"""with d as ({domain}), r as ({' union all '.join(parts)}),
    v as (select rule, {count('ok')} as rows_checked, {count('ok and fine')} as defined, {count('ok and bad')} as violations, {witness}, count(*) as every from r group by rule)
    select * exclude (every), case when rows_checked = 0 then 'vacuous' when violations > 0 then 'refuted' when defined = 0 then 'vacuous' when {whole} then 'bounded-proved@{width}' else 'sampled-agree' end as status from v"""


X, Y, Z = "x", "y", "z"
# The catalogue of rules with known verdicts.
IDENTITIES = [
    Rule("add-assoc-const", ("add", ("add", X, 3), 5), ("add", X, 8)), Rule("add-comm", ("add", X, Y), ("add", Y, X)), Rule("mul-comm", ("mul", X, Y), ("mul", Y, X)),
    Rule("and-zero", ("and", X, 0), 0), Rule("or-allones", ("or", X, 255), 255), Rule("mul-zero", ("mul", X, 0), 0), Rule("xor-zero", ("xor", X, 0), X),
    Rule("and-self", ("and", X, X), X), Rule("or-self", ("or", X, X), X), Rule("sub-self", ("sub", X, X), 0), Rule("xor-self", ("xor", X, X), 0),
    Rule("shl-zero", ("shl", X, 0), X), Rule("lshr-zero", ("lshr", X, 0), X), Rule("ashr-zero", ("ashr", X, 0), X), Rule("mul-one", ("mul", X, 1), X),
    Rule("double-shift", ("add", X, X), ("shl", X, 1)), Rule("distribute", ("mul", X, ("add", Y, 3)), ("add", ("mul", X, Y), ("mul", X, 3))), Rule("demorgan", ("not", ("and", X, Y)), ("or", ("not", X), ("not", Y))),
    Rule("sub-as-add", ("sub", X, Y), ("add", X, ("neg", Y))), Rule("masks-meet", ("or", ("and", X, Y), ("and", X, ("not", Y))), X),
]
NEGATIVES = [
    Rule("add-one-identity", ("add", X, 1), X), Rule("mul-zero-identity", ("mul", X, 0), X), Rule("sub-self-identity", ("sub", X, X), X), Rule("xor-self-identity", ("xor", X, X), X),
    Rule("and-self-zero", ("and", X, X), 0), Rule("or-zero-ones", ("or", X, 0), 255), Rule("add-wrong-variable", ("add", X, 0), Y), Rule("sub-comm", ("sub", X, Y), ("sub", Y, X)),
    Rule("wrong-factor", ("mul", X, 3), ("add", X, ("shl", X, 2))),
]
FLAGS = [
    Rule("drop-nsw", ("add", X, Y, "nsw"), ("add", X, Y)), Rule("add-nsw", ("add", X, Y), ("add", X, Y, "nsw")), Rule("drop-nuw", ("mul", X, Y, "nuw"), ("mul", X, Y)),
    Rule("nuw-round-trip", ("lshr", ("shl", X, Y, "nuw"), Y), X), Rule("plain-round-trip", ("lshr", ("shl", X, Y), Y), X), Rule("drop-exact", ("udiv", X, Y, "exact"), ("udiv", X, Y)),
    Rule("disjoint-or-add", ("or", X, Y, "disjoint"), ("add", X, Y)), Rule("or-add", ("or", X, Y), ("add", X, Y)), Rule("all-poison", ("poison", X), Y),
]
GUARDED = [
    Rule("sdiv-udiv-nonneg", ("sdiv", X, Y), ("udiv", X, Y), assume="x < 128 and y < 128 and y > 0"), Rule("sdiv-udiv", ("sdiv", X, Y), ("udiv", X, Y)),
    Rule("urem-pow2", ("urem", X, Y), ("and", X, ("sub", Y, 1)), assume="y > 0 and bit_count(y) = 1"), Rule("urem-any", ("urem", X, Y), ("and", X, ("sub", Y, 1))),
    Rule("known-bits", ("and", X, 15), X, assume="(x & 240) = 0"), Rule("impossible", ("add", X, 1), X, assume="x < 0"),
]
LIFTED = [
    Rule("add-zero", ("add", X, 0), X), Rule("mul-one", ("mul", X, 1), X), Rule("sub-zero", ("sub", X, 0), X), Rule("or-zero", ("or", X, 0), X), Rule("and-allones", ("and", X, 255), X),
    Rule("xor-self", ("xor", X, X), 0), Rule("and-self", ("and", X, X), X), Rule("or-self", ("or", X, X), X), Rule("sub-self", ("sub", X, X), 0), Rule("mul-zero", ("mul", X, 0), 0),
    Rule("shl-zero", ("shl", X, 0), X), Rule("ashr-zero", ("ashr", X, 0), X), Rule("xor-zero", ("xor", X, 0), X), Rule("lshr-zero", ("lshr", X, 0), X),
]
STEPS = [
    Rule("gvn-commutative", ("sub", ("add", X, Y), ("add", Y, X)), 0), Rule("sub-not-commutative", ("sub", ("sub", X, Y), ("sub", Y, X)), 0), Rule("reassociate-add", ("add", ("add", X, 7), ("add", Y, 9)), ("add", ("add", X, Y), 16)),
    Rule("reassociate-mul", ("mul", ("mul", X, 3), ("mul", Y, 5)), ("mul", ("mul", X, Y), 15)), Rule("factor", ("add", ("mul", X, 3), ("mul", Y, 3)), ("mul", ("add", X, Y), 3)),
    Rule("factor-wrong-sign", ("sub", ("mul", X, 3), ("mul", Y, 3)), ("mul", ("add", X, Y), 3)), Rule("double-to-shift", ("add", ("add", X, X), Y), ("add", ("shl", X, 1), Y)),
]
TRIPLES = [
    Rule("add-associative", ("add", ("add", X, Y), Z), ("add", X, ("add", Y, Z))), Rule("mul-associative", ("mul", ("mul", X, Y), Z), ("mul", X, ("mul", Y, Z))),
    Rule("sub-not-associative", ("sub", ("sub", X, Y), Z), ("sub", X, ("sub", Y, Z))), Rule("distribute", ("mul", X, ("add", Y, Z)), ("add", ("mul", X, Y), ("mul", X, Z))),
]
UNDEFINED = [
    Rule("udiv-self", ("udiv", X, X), 1, ub=True), Rule("sdiv-self", ("sdiv", X, X), 1, ub=True), Rule("speculate-division", ("select", ("eq", Y, 0), X, ("add", X, 1)), ("udiv", X, Y), ub=True),
    Rule("srem-minus-one", ("srem", X, 255), 0, ub=True), Rule("srem-minus-one-back", 0, ("srem", X, 255), ub=True), Rule("udiv-by-shift", ("udiv", X, 8), ("lshr", X, 3), ub=True),
    Rule("shift-pair", ("lshr", ("shl", X, Y), Y), X, ub=True), Rule("shift-pair-nuw", ("lshr", ("shl", X, Y, "nuw"), Y), X, ub=True), Rule("abs-nomin", ("abs", X, "nomin"), ("abs", X), ub=True),
    Rule("abs-add-nomin", ("abs", X), ("abs", X, "nomin"), ub=True), Rule("ctlz-nozero", ("ctlz", X, "nozero"), ("ctlz", X), ub=True), Rule("cttz-add-nozero", ("cttz", X), ("cttz", X, "nozero"), ub=True),
]
POISONED = [
    Rule("select-same-arms", ("select", ("ult", X, Y), Y, Y), Y), Rule("select-to-and", ("select", ("eq", X, 0), Y, 0), ("and", Y, ("sub", 0, ("eq", X, 0)))), Rule("poison-flows", ("add", X, Y), ("add", Y, X), False),
    Rule("drop-operand", ("and", X, 0), 0), Rule("add-operand", 0, ("and", X, 0)), Rule("pick-poison", X, ("poison", X)),
]
CALLS = [
    Rule("inline-and-simplify", ("sub", ("add", X, Y), Y), X), Rule("fold-constant-argument", ("mul", ("add", 3, 4), X), ("mul", 7, X)), Rule("distribute-call", ("mul", 5, ("sub", X, Y)), ("sub", ("mul", 5, X), ("mul", 5, Y))),
    Rule("swap-arguments", ("sub", X, Y), ("sub", Y, X)), Rule("drop-used-argument", ("add", X, Y), X),
]
BRANCHES = [
    Rule("identical-arms", ("select", ("ult", X, Y), ("add", X, Y), ("add", Y, X)), ("add", X, Y)), Rule("tautology", ("select", ("uge", X, 0), X, Y), X), Rule("no-tautology", ("select", ("ugt", X, 0), X, Y), X),
    Rule("nested-and", ("select", ("ult", X, 16), ("select", ("ult", Y, 16), 1, 0), 0), ("and", ("ult", X, 16), ("ult", Y, 16))), Rule("nested-or", ("select", ("ult", X, 16), 1, ("select", ("ult", Y, 16), 1, 0)), ("or", ("ult", X, 16), ("ult", Y, 16))),
    Rule("sink-common-code", ("select", ("ult", X, Y), ("add", X, 3), ("add", Y, 3)), ("add", ("umin", X, Y), 3)),
]
