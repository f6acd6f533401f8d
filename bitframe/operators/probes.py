"""Abstract records of configurations, probes over them, markers, categories and reduction that preserves markers.

A record is an array of instructions and one of blocks, laid out by the configuration's shapes; probes are predicates over those
arrays. ``CLOSED`` states each marker as a condition on the configuration alone, which is what the search for smaller
configurations evaluates, and what the SQL checks the probes against.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers in their order, with the patch of the default row that brings each about.
MARKERS = {
    "probe.instcombine.add-zero": {"arith_opcode": 0, "rhs_mode": 0}, "probe.instcombine.sub-zero": {"arith_opcode": 1, "rhs_mode": 0},
    "probe.instcombine.mul-one": {"arith_opcode": 2, "rhs_mode": 1}, "probe.instcombine.xor-self": {"extra_opcode": 3},
    "probe.instcombine.or-zero": {"arith_opcode": 4, "rhs_mode": 0}, "probe.instcombine.and-allones": {"arith_opcode": 5, "const_a": -1, "rhs_mode": 3},
    "probe.instcombine.and-self": {"extra_opcode": 5}, "probe.dce.dead-instruction": {"extra_opcode": 4},
    "probe.simplifycfg.unreachable-block": {"shape": 3}, "probe.simplifycfg.diamond": {"shape": 1}, "probe.simplifycfg.nested-branch": {"shape": 2}, "probe.simplifycfg.branch-chain": {"shape": 4},
    "probe.mem2reg.promotable-alloca": {"memory_shape": 1}, "probe.mem2reg.store-load-forward": {"memory_shape": 1}, "probe.dse.dead-store": {"memory_shape": 3},
    "probe.dse.overwritten-store": {"memory_shape": 4}, "probe.instcombine.redundant-load": {"memory_shape": 2}, "probe.cleanup.unused-alloca": {"memory_shape": 5},
    "probe.loop.canonical-header": {"loop_shape": 1}, "probe.loop.induction-phi": {"loop_shape": 1}, "probe.loop.simple-trip-count": {"loop_shape": 1},
    "probe.licm.invariant-op": {"loop_shape": 3}, "probe.dce.dead-loop-instruction": {"loop_shape": 4}, "probe.simplifycfg.loop-exit": {"loop_shape": 2},
    "probe.globalopt.dead-initializer": {"global_shape": 1},
}
VECTOR_MARKERS = (
    "add-zero", "mul-one", "xor-self", "shuffle-identity", "shuffle-splat", "extract-insert", "reduction-add-zero", "sub-zero", "or-zero", "and-allones", "insert-extract-identity", "reduction-add-single-lane",
    "scalable.add-zero", "scalable.mul-one", "scalable.xor-self", "scalable.sub-zero", "scalable.or-zero", "scalable.and-allones", "scalable.reduction-add-zero", "smin", "smax", "umin", "umax", "abs",
)
MARKERS |= {f"probe.vector.{m}": {"vector_shape": i + 1} for i, m in enumerate(VECTOR_MARKERS)}
PIPELINES = {"memory": "mem2reg,dse,instcombine", "loop": "loop-simplify,licm,indvars,simplifycfg,instcombine", "cfg": "simplifycfg,instcombine"}

_OF = "array<struct<opcode:string,lhs:string,rhs:string,rhs_const:bigint,block:int,dead:boolean,slot:int>>"
_OPEN = "global_shape = 0 and vector_shape = 0"
_PLAIN = f"{_OPEN} and memory_shape = 0"  # laid out as a loop or by its shape
_FLAT = f"{_PLAIN} and loop_shape = 0"
_CONST = "(case rhs_mode when 0 then 0 when 1 then 1 when 3 then const_a end)"  # null: no constant

#: Each marker as a condition on the configuration.
CLOSED = {
    "probe.instcombine.add-zero": f"({_PLAIN} and arith_opcode = 0 and coalesce({_CONST} = 0, false)) or ({_FLAT} and (extra_opcode = 1 or (extra_opcode = 4 and const_b = 0)))",
    "probe.instcombine.sub-zero": f"{_PLAIN} and arith_opcode = 1 and coalesce({_CONST} = 0, false)",
    "probe.instcombine.mul-one": f"({_PLAIN} and arith_opcode = 2 and coalesce({_CONST} = 1, false)) or ({_FLAT} and extra_opcode = 2)",
    "probe.instcombine.xor-self": f"{_FLAT} and extra_opcode = 3",
    "probe.instcombine.or-zero": f"{_PLAIN} and arith_opcode = 4 and coalesce({_CONST} = 0, false)",
    "probe.instcombine.and-allones": f"{_PLAIN} and arith_opcode = 5 and coalesce({_CONST} = -1, false)",
    "probe.instcombine.and-self": f"{_FLAT} and extra_opcode = 5",
    "probe.dce.dead-instruction": f"{_FLAT} and (extra_opcode = 4 or shape = 3)",
    "probe.simplifycfg.unreachable-block": f"{_FLAT} and shape = 3",
    "probe.simplifycfg.diamond": f"({_FLAT} and shape = 1) or ({_OPEN} and memory_shape = 1 and store_mode = 2)",
    "probe.simplifycfg.nested-branch": f"{_PLAIN} and shape = 2",
    "probe.simplifycfg.branch-chain": f"{_PLAIN} and shape = 4",
    "probe.mem2reg.promotable-alloca": f"{_OPEN} and memory_shape between 1 and 4",
    "probe.mem2reg.store-load-forward": f"{_OPEN} and memory_shape in (1, 2, 4)",
    "probe.dse.dead-store": f"{_OPEN} and memory_shape = 3",
    "probe.dse.overwritten-store": f"{_OPEN} and memory_shape = 4",
    "probe.instcombine.redundant-load": f"{_OPEN} and memory_shape = 2",
    "probe.cleanup.unused-alloca": f"{_OPEN} and memory_shape = 5",
    "probe.loop.canonical-header": f"{_OPEN} and loop_shape <> 0",
    "probe.loop.induction-phi": f"{_PLAIN} and loop_shape <> 0",
    "probe.loop.simple-trip-count": f"{_PLAIN} and loop_shape <> 0",
    "probe.licm.invariant-op": f"{_OPEN} and loop_shape = 3",
    "probe.dce.dead-loop-instruction": f"{_OPEN} and loop_shape = 4",
    "probe.simplifycfg.loop-exit": f"loop_shape <> 0 and (({_PLAIN}) or ({_OPEN} and memory_shape = 1 and store_mode = 2))",
    "probe.globalopt.dead-initializer": "global_shape <> 0",
} | {m: f"global_shape = 0 and vector_shape = {p['vector_shape']}" for m, p in MARKERS.items() if "vector_shape" in p}
CATEGORY = "case when global_shape <> 0 then 'global' when vector_shape <> 0 then 'vector' when memory_shape <> 0 then 'memory' when loop_shape <> 0 then 'loop' when shape <> 0 then 'cfg' else 'scalar' end"


def _step(opcode: Column | str, block: int, lhs: str = "a", rhs: Column | str = "const", const: Column | int = 0, dead: bool = False, slot: Column | int = 0) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(opcode).alias("opcode"), F.lit(lhs).alias("lhs"), lit(rhs).alias("rhs"), lit(const).cast("bigint").alias("rhs_const"), F.lit(block).alias("block"), F.lit(dead).alias("dead"), lit(slot).cast("int").alias("slot"))


def _arith(block: int, lhs: str = "a", dead: bool = False) -> Column:
    ops = F.array(*[F.lit(x) for x in ("add", "sub", "mul", "xor", "or", "and")])
    const = F.when(F.col("rhs_mode") == 1, 1).when(F.col("rhs_mode") == 3, F.col("const_a")).otherwise(0)
    return _step(ops[F.col("arith_opcode").cast("int")], block, lhs, F.when(F.col("rhs_mode") == 2, "b").otherwise("const"), const, dead)


def _pick(column: str, cases: dict[int, Column], otherwise: Column) -> Column:
    out = otherwise
    for value, then in cases.items():
        out = F.when(F.col(column) == value, then).otherwise(out)
    return out


def instructions() -> Column:
    """The instructions of a configuration, in their order; none if it has a global or vector shape."""
    seq = lambda *steps: F.array(*steps).cast(_OF)
    none = F.lit([]).cast(_OF)
    extra = lambda block: _pick("extra_opcode", {
        1: seq(_step("add", block, "value")), 2: seq(_step("mul", block, "value", const=1)), 3: seq(_step("xor", block, "value", "same")),
        4: seq(_step("add", block, "value", const=F.col("const_b"), dead=True)), 5: seq(_step("and", block, "value", "same")),
    }, none)
    slot = (F.col("pointer_mode") == 1).cast("int")
    memory = lambda op, block=0, dead=False: _step(op, block, dead=dead, slot=slot)
    places = F.concat(seq(_step("alloca", 0)), _pick("pointer_mode", {1: seq(_step("alloca", 0, slot=1)), 2: seq(_step("gep", 0))}, none))
    stored = _pick("store_mode", {
        1: seq(memory("store"), memory("store", dead=True), memory("load")), 2: seq(memory("store", 1), memory("store", 2), memory("load", 3)),
    }, seq(memory("store"), memory("load")))
    in_memory = F.concat(places, _pick("memory_shape", {
        1: stored, 2: seq(memory("store"), memory("load"), memory("load")), 3: seq(memory("store", dead=True)), 4: seq(memory("store", dead=True), memory("store"), memory("load")),
    }, none))
    body = _pick("loop_shape", {3: seq(_arith(2, "b")), 4: seq(_arith(2, "value", True)), 2: seq(_arith(2, "value"), _step("icmp", 2), _step("branch", 2))}, seq(_arith(2, "value")))
    looped = F.concat(seq(_step("branch", 0), _step("phi", 1), _step("icmp", 1), _step("branch", 1)), body, seq(_arith(3, "value"), _step("branch", 3)))
    shaped = _pick("shape", {
        0: F.concat(seq(_arith(0)), extra(0)), 1: F.concat(seq(_arith(1), _arith(2, "b")), extra(3)), 2: F.concat(seq(_arith(2), _arith(3, "b"), _arith(4, "b")), extra(5)),
        3: F.concat(seq(_arith(0)), extra(0), seq(_arith(1, "b", True))), 4: F.concat(seq(_arith(1), _arith(3, "b"), _arith(4)), extra(5)),
    }, none)
    return F.when((F.col("global_shape") != 0) | (F.col("vector_shape") != 0), none).when(F.col("memory_shape") != 0, in_memory).when(F.col("loop_shape") != 0, looped).otherwise(shaped)


def blocks() -> Column:
    """Blocks of a configuration: reachable, branches, merges."""
    def made(n: int, branching: Sequence[int] = (), merging: Sequence[int] = (), lost: Sequence[int] = ()) -> Column:
        return F.array(*[F.struct(F.lit(i not in lost).alias("reachable"), F.lit(i in branching).alias("branches"), F.lit(i in merging).alias("merges")) for i in range(n)])

    in_memory = F.when(F.col("store_mode") != 2, made(1)).when(F.col("memory_shape") == 1, made(4, [0], [3])).otherwise(made(4))
    shaped = _pick("shape", {1: made(4, [0], [3]), 2: made(6, [0, 1], [5]), 3: made(2, lost=[1]), 4: made(6, [0, 2], [5])}, made(1))
    return F.when((F.col("global_shape") != 0) | (F.col("vector_shape") != 0), made(1)).when(F.col("memory_shape") != 0, in_memory).when(F.col("loop_shape") != 0, made(5, [1, 3], [4])).otherwise(shaped)


def records(configs: DataFrame) -> DataFrame:
    """``configs`` with instructions and blocks."""
    return configs.withColumns({"instructions": instructions(), "blocks": blocks()})


def probes() -> dict[str, Column]:
    """Each marker as a predicate over a record's instructions, blocks and shapes."""
    steps, parts = F.col("instructions"), F.col("blocks")
    some = lambda test: F.exists(steps, test)
    op = lambda name: some(lambda i: i.opcode == name)
    count = lambda name: F.size(F.filter(steps, lambda i: i.opcode == name))
    const = lambda name, value: some(lambda i: (i.opcode == name) & (i.rhs == "const") & (i.rhs_const == value))
    same = lambda name: some(lambda i: (i.opcode == name) & (i.rhs == "same"))
    dead = lambda test: some(lambda i: i.dead & test(i))
    shape, memory, loop = F.col("shape"), F.col("memory_shape"), F.col("loop_shape")
    branching = F.size(F.filter(parts, lambda b: b.branches))
    merges, looping = F.exists(parts, lambda b: b.merges), loop != 0
    plain = {
        "instcombine.add-zero": const("add", 0), "instcombine.sub-zero": const("sub", 0), "instcombine.mul-one": const("mul", 1), "instcombine.xor-self": same("xor"), "instcombine.or-zero": const("or", 0),
        "instcombine.and-allones": const("and", -1), "instcombine.and-self": same("and"), "dce.dead-instruction": dead(lambda i: i.opcode != "store") & (loop != 4),
        "simplifycfg.unreachable-block": F.exists(parts, lambda b: ~b.reachable), "simplifycfg.diamond": (branching == 1) & merges,
        "simplifycfg.nested-branch": (branching > 1) & (shape == 2), "simplifycfg.branch-chain": (branching > 1) & (shape == 4),
        "mem2reg.promotable-alloca": op("alloca") & ~memory.isin(0, 5), "mem2reg.store-load-forward": op("store") & op("load"),
        "dse.dead-store": dead(lambda i: i.opcode == "store") & (memory == 3), "dse.overwritten-store": dead(lambda i: i.opcode == "store") & (memory == 4),
        "instcombine.redundant-load": count("load") > 1, "cleanup.unused-alloca": op("alloca") & ~op("store") & ~op("load") & (memory == 5),
        "loop.canonical-header": looping, "loop.induction-phi": looping & op("phi"), "loop.simple-trip-count": looping & op("icmp"), "licm.invariant-op": loop == 3,
        "dce.dead-loop-instruction": loop == 4, "simplifycfg.loop-exit": looping & (branching > 0),
    }
    whole, lanes = F.col("global_shape") == 0, F.col("vector_shape") == 0
    out = {f"probe.{m}": whole & lanes & c for m, c in plain.items()} | {"probe.globalopt.dead-initializer": ~whole}
    out |= {f"probe.vector.{m}": whole & (F.col("vector_shape") == i + 1) for i, m in enumerate(VECTOR_MARKERS)}
    return {m: out[m] for m in MARKERS}


def markers() -> Column:
    """A record's markers in their order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(m)) for m, c in probes().items()]))


def preserved(found: Column, required: Column) -> Column:
    """Is every required marker there?"""
    return F.size(F.array_except(required, found)) == 0


def oracle_status(expected: Column, observed: Column, extra: bool = False) -> Column:
    """not-instrumented without observations; matched, if nothing is missing and, unless ``extra`` is allowed, nothing unexpected; else mismatch."""
    good = F.size(F.array_except(expected, observed)) == 0
    good = good if extra else good & (F.size(F.array_except(observed, expected)) == 0)
    return F.when(F.size(observed) == 0, "not-instrumented").when(good, "matched").otherwise("mismatch")


# Fields in the order in which they are made smaller, with the values that are tried.
REDUCED = {
    "feature_bits": range(4), "const_a": (0, 1, -1), "const_b": (0, 1, -1), "load_use_mode": range(3), "store_mode": range(3), "pointer_mode": range(3), "memory_shape": range(6), "loop_use_mode": range(3),
    "induction_mode": range(3), "loop_trip_mode": range(3), "loop_shape": range(5), "vector_shape": range(25), "global_shape": range(4), "predicate": range(4), "extra_opcode": range(6), "rhs_mode": range(4),
    "arith_opcode": range(6), "shape": range(5),
}


def smaller(field: str, marker: str) -> str:
    """SQL text of a field made as small as ``marker`` allows, all other fields as they are.

    Kinds take the least value that keeps the marker; constants the first of 0, 1, -1 that they have or that keeps it.
    """
    keeps = lambda v: "(" + re.sub(rf"\b{field}\b", f"({v})", CLOSED[marker]) + ")"
    if field in ("const_a", "const_b"):
        return "case " + " ".join(f"when {field} = {v} or {keeps(v)} then {v}" for v in REDUCED[field]) + f" else {field} end"
    return "case " + " ".join(f"when {v} < {field} and {keeps(v)} then {v}" for v in REDUCED[field]) + f" else {field} end"


def reduced(configs: DataFrame, marker: str) -> DataFrame:
    """``configs``, which have ``marker``, with each field in turn made smaller: eighteen projections, no shuffle."""
    for field in REDUCED:
        configs = configs.withColumn(field, F.expr(smaller(field, marker)).cast("bigint"))
    return configs
