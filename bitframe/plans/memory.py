"""Memory as a value of expressions, contracts over small complete models of it, and their verdicts.

Memory is an array of cells; a store gives a new array, a load reads a cell. A contract compares two sequences of steps by what
they leave: memory, a named load, or snapshots at points of synchronisation. What holds for memory of whole words under facts of
equality only depends on which addresses and values are equal, so as many cells as addresses, one more, and as many values as
symbols decide a contract for every size; verdicts over such a model say ``proved``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS, VALUES = 3, 4  # two addresses and one cell more; values are two bits each


class Contract(NamedTuple):
    """Steps: ("store", address, value), ("sync", address, value), ("load", name, address), ("bind", name, value), ("if", condition, then, else), ("pick", address, condition, a, b)."""

    name: str
    before: list
    after: list
    seen: str = "memory"
    assume: str = "true"


class Memory(NamedTuple):
    """How an engine writes arrays of cells."""

    put: str
    get: str
    cells: str


SPARK = Memory("transform({m}, (v, i) -> if(i = {a}, {x}, v))", "element_at({m}, cast({a} as int) + 1)", "array({c})")
DUCKDB = Memory("list_transform({m}, lambda v, i: case when i - 1 = {a} then {x} else v end)", "{m}[{a} + 1]", "[{c}]")


def ran(steps: list, memory: str, names: dict[str, str], engine: Memory, snaps: list[str] | None = None) -> str:
    """SQL text of the memory after the steps; loads and bindings are put into ``names``, memories at synchronisations into ``snaps``."""
    value = lambda x: names.get(x, x)
    for kind, *args in steps:
        if kind in ("store", "sync"):
            memory = engine.put.format(m=memory, a=args[0], x=value(args[1]))
            if kind == "sync" and snaps is not None:
                snaps.append(memory)
        elif kind == "load":
            names[args[0]] = engine.get.format(m=memory, a=args[1])
        elif kind == "bind":
            names[args[0]] = value(args[1])
        elif kind == "pick":
            memory = engine.put.format(m=memory, a=args[0], x=f"(case when {args[1]} = 1 then {value(args[2])} else {value(args[3])} end)")
        else:
            arms = [ran(a, memory, dict(names), engine) for a in args[1:]]
            memory = f"(case when {args[0]} = 1 then {arms[0]} else {arms[1]} end)"
    return memory


def differs(c: Contract, engine: Memory) -> str:
    """SQL text of when the two sides of a contract differ in what is seen of them. Different numbers of snapshots always differ."""
    start = engine.cells.format(c=", ".join(f"m{i}" for i in range(CELLS)))
    sides = []
    for steps in (c.before, c.after):
        names: dict[str, str] = {}
        snaps: list[str] = []
        last = ran(steps, start, names, engine, snaps)
        sides.append([names[c.seen]] if c.seen not in ("memory", "order") else [last, *(snaps if c.seen == "order" else [])])
    if len(sides[0]) != len(sides[1]):
        return "true"
    return " or ".join(f"({a}) <> ({b})" for a, b in zip(*sides))


_BITS = {"p": 2, "q": 2, "v0": 2, "v1": 2, "v2": 2, "c": 1} | {f"m{i}": 2 for i in range(CELLS)}


def _domain(shift: str) -> list[str]:
    at, parts = 0, []
    for name, bits in _BITS.items():
        parts.append(f"({shift.format(n=at)}) & {2**bits - 1} as {name}")
        at += bits
    return parts


ROWS = 2 ** sum(_BITS.values())


def model(spark: SparkSession, ids: DataFrame | None = None) -> DataFrame:
    """All cells, addresses, values and one condition. ``ids``: only these of the counter below ROWS, each once, or those of ``verify.counted`` with n and met."""
    return (spark.range(ROWS) if ids is None else ids).selectExpr(*_domain("shiftright(id, {n})"), *(["n", "met"] if ids is not None and "met" in ids.columns else [])).where(f"p < {CELLS} and q < {CELLS}")


def verdicts(domain: DataFrame, contracts: list[Contract]) -> DataFrame:
    """contract, rows_checked, violations, status: one aggregate for each four contracts, nothing is shuffled but its results.

    Where the domain has n and met, n counts, and rows_met and violations_met say the same of a table's rows.
    """
    out, met = None, "met" in domain.columns
    kinds = {"rows_checked": ("r", "n", False), "violations": ("b", "n", True)} | ({"rows_met": ("m", "met", False), "violations_met": ("h", "met", True)} if met else {})
    count = lambda of, test: F.expr(f"coalesce(sum(case when {test} then {of} else 0L end), 0L)") if met else F.count_if(F.expr(test))
    for k in range(0, len(contracts), 4):
        some = contracts[k : k + 4]
        sums = [count(of, f"({c.assume}) and ({differs(c, SPARK)})" if bad else f"({c.assume})").alias(f"{at}{i}") for i, c in enumerate(some) for at, of, bad in kinds.values()]
        rows = F.array(*[F.struct(F.lit(c.name).alias("contract"), *[F.col(f"{at}{i}").alias(name) for name, (at, _, _) in kinds.items()]) for i, c in enumerate(some)])
        part = domain.agg(*sums).select(F.inline(rows))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("status", F.when(F.col("rows_checked") == 0, "vacuous").when(F.col("violations") > 0, "refuted").otherwise("proved"))


def verdicts_sql(contracts: list[Contract], ids: str) -> str:
    """The same in DuckDB's SQL; ``ids``: what gives the counter i, n and met."""
    domain = f"select * from (select {', '.join(_domain('i >> {n}'))}, n, met from {ids}) where p < {CELLS} and q < {CELLS}"
    parts = [f"select '{c.name}' as contract, n, met, ({c.assume}) as ok, ({differs(c, DUCKDB)}) as bad from d" for c in contracts]
    count = lambda of, test: f"coalesce(sum({of}) filter ({test}), 0)::BIGINT"
    return f"with d as ({domain}), r as ({' union all '.join(parts)}), v as (select contract, {count('n', 'ok')} as rows_checked, {count('n', 'ok and bad')} as violations, {count('met', 'ok')} as rows_met, {count('met', 'ok and bad')} as violations_met from r group by contract) select *, case when rows_checked = 0 then 'vacuous' when violations > 0 then 'refuted' else 'proved' end as status from v"


_S, _L = "store", "load"
# Contracts with known verdicts under their published names, in the published order.
WORDS = [
    Contract("dse-dead-store-same-addr-sound", [(_S, "p", "v0"), (_S, "p", "v1")], [(_S, "p", "v1")]),
    Contract("dse-dead-store-diff-addr-unsound", [(_S, "p", "v0"), (_S, "q", "v1")], [(_S, "q", "v1")]),
    Contract("store-load-forward-sound", [(_S, "p", "v0"), (_L, "r", "p")], [(_S, "p", "v0"), ("bind", "r", "v0")], "r"),
    Contract("load-noalias-preserved-sound", [(_S, "p", "v0"), (_L, "r", "q")], [(_L, "r", "q")], "r", "p <> q"),
    Contract("overwritten-store-fully-killed-sound", [(_S, "p", "v0"), (_S, "p", "v1"), (_L, "r", "p")], [("bind", "r", "v1")], "r"),
    Contract("store-forward-wrong-value-unsound", [(_S, "p", "v0"), (_L, "r", "p")], [(_S, "p", "v0"), ("bind", "r", "v1")], "r"),
    Contract("dse-overwrite", [(_S, "p", "v0"), (_S, "q", "v1")], [(_S, "q", "v1")], assume="p = q"),
    Contract("store-forward-across-noalias", [(_S, "p", "v0"), (_S, "q", "v1"), (_L, "r", "p")], [(_S, "p", "v0"), (_S, "q", "v1"), ("bind", "r", "v0")], "r", "p <> q"),
    Contract("redundant-load-across-noalias", [(_L, "r1", "p"), (_S, "q", "v0"), (_L, "r2", "p")], [(_L, "r1", "p"), (_S, "q", "v0"), ("bind", "r2", "r1")], "r2", "p <> q"),
]
# The same without the fact that they need, and one under a fact that never holds.
WORDS += [c._replace(name=f"{c.name}: fact dropped", assume="true") for c in WORDS if c.assume != "true" and c.name != "dse-overwrite"]
WORDS += [Contract("impossible-fact", [(_S, "p", "v0")], [], assume="p <> p")]
# Published names and order.
PATHS = [
    Contract("dse-across-diamond-allpaths", [(_S, "p", "v0"), ("if", "c", [(_S, "p", "v1")], [(_S, "p", "v2")])], [("if", "c", [(_S, "p", "v1")], [(_S, "p", "v2")])]),
    Contract("dse-across-diamond-onepath", [(_S, "p", "v0"), ("if", "c", [(_S, "p", "v1")], [(_S, "q", "v2")])], [("if", "c", [(_S, "p", "v1")], [(_S, "q", "v2")])], assume="p <> q"),
    Contract("store-sink-conditional", [("if", "c", [(_S, "p", "v1")], [(_S, "p", "v2")])], [("pick", "p", "c", "v1", "v2")]),
]
# Published names and order; the last one drops a fact.
ORDER = [
    Contract("dse-nonatomic-overwrite", [(_S, "p", "v0"), (_S, "p", "v1")], [(_S, "p", "v1")], "order"),
    Contract("dse-atomic-store-not-eliminable", [("sync", "p", "v0"), (_S, "p", "v1")], [(_S, "p", "v1")], "order"),
    Contract("reorder-store-across-sync", [(_S, "q", "v1"), ("sync", "p", "v0")], [("sync", "p", "v0"), (_S, "q", "v1")], "order", "p <> q"),
    Contract("reorder-nonatomic-nonalias", [(_S, "p", "v0"), (_S, "q", "v1")], [(_S, "q", "v1"), (_S, "p", "v0")], "order", "p <> q"),
    Contract("reorder-nonatomic-nonalias: fact dropped", [(_S, "p", "v0"), (_S, "q", "v1")], [(_S, "q", "v1"), (_S, "p", "v0")], "order"),
]
