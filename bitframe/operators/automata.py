"""Region patterns over ordered rows: a finite automaton as maps of states that compose.

What a block of rows does to the automaton is a map from the state before to the state after, with the row at which an open region began. Maps compose
and composing is associative, so the blocks of a large key are mapped beside each other, then composed, block of blocks by block of blocks, and
last each block is run from the state it is entered in.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from . import ordered

BLOCK_BITS = 12


class Automaton(NamedTuple):
    """States are numbers, 0 is idle; ``step[state][symbol]``: (next state, whether a region begins here); a region ends where ``accept`` is entered.

    The last symbol stands for all that aren't named. A region begins when idle is left and is given up when idle is entered.
    """

    symbols: tuple[str, ...]
    step: tuple[tuple[tuple[int, bool], ...], ...]
    accept: int


def sequence(roles: Sequence[str], gap: int, breaks: Sequence[str] = ()) -> Automaton:
    """Rows of the given roles in order, at most ``gap`` other rows between neighbours, none of ``breaks``. The first role, seen again before the next one, begins anew."""
    symbols = (*dict.fromkeys((*roles, *breaks)), "")
    states = 1 + (len(roles) - 1) * (gap + 1)  # idle, then (roles seen, rows since); the last one accepts

    def state(seen: int, since: int) -> int:
        return 1 + (seen - 1) * (gap + 1) + since

    rows = []
    for s in range(states):
        seen, since = (0, 0) if s == 0 else (1 + (s - 1) // (gap + 1), (s - 1) % (gap + 1))
        row = []
        for x in symbols:
            if x == roles[seen]:
                row.append((state(seen + 1, 0) if seen + 1 < len(roles) else states, seen == 0))
            elif x == roles[0]:
                row.append((state(1, 0), True))
            elif s == 0 or x in breaks or since >= gap:
                row.append((0, False))
            else:
                row.append((state(seen, since + 1), False))
        rows.append(tuple(row))
    return Automaton(symbols, tuple(rows), states)


_STATE = "struct<state:int,began:bigint>"


def _stepped(machine: Automaton, so_far: Column, row: Column) -> tuple[Column, Column, Column]:
    """(state after a row, the row at which its region began, whether one ended)."""
    k = len(machine.symbols)
    nexts = F.lit([s for row in machine.step for s, _ in row])
    anew = F.lit([b for row in machine.step for _, b in row])
    at = so_far["state"] * k + row["symbol"]
    state = F.get(nexts, at)
    ended = state == machine.accept
    began = F.when(F.get(anew, at) | (so_far["state"] == 0), row["ref"]).otherwise(so_far["began"])
    return state, began, ended


def _mapped(machine: Automaton, rows: Column) -> Column:
    """What a block of rows does to each state: a null began is that of the region which was open before."""

    def one(so_far: Column, row: Column) -> Column:
        state, began, ended = _stepped(machine, so_far, row)
        idle = ended | (state == 0)
        return F.struct(F.when(idle, 0).otherwise(state).alias("state"), F.when(~idle, began).alias("began")).cast(_STATE)

    return F.transform(F.sequence(F.lit(0), F.lit(machine.accept - 1)), lambda s: F.aggregate(rows, F.struct(s.alias("state"), F.lit(None).cast("bigint").alias("began")).cast(_STATE), one))


def _then(so_far: Column, step: Column) -> Column:
    """A state, then the map of a block."""
    after = F.get(step, so_far["state"])
    return F.struct(after["state"].alias("state"), F.coalesce(after["began"], F.when(after["state"] > 0, so_far["began"])).alias("began")).cast(_STATE)


def _entered(maps: DataFrame, keys: Sequence[str], accept: int, bits: int) -> DataFrame:
    """keys, block, enter: the state in which each block is entered. maps: keys, block, map."""
    idle = F.struct(F.lit(0).alias("state"), F.lit(None).cast("bigint").alias("began")).cast(_STATE)
    if not (maps.agg(F.max("block")).first()[0] or 0):
        return maps.select(*keys, "block", idle.alias("enter"))
    up = F.shiftright("block", bits)
    wide = checkpointed(maps.groupBy(*keys, up.alias("up")).agg(F.sort_array(F.collect_list(F.struct("block", "map"))).alias("maps")))
    every = F.transform(F.sequence(F.lit(0), F.lit(accept - 1)), lambda s: F.aggregate("maps", F.struct(s.alias("state"), F.lit(None).cast("bigint").alias("began")).cast(_STATE), lambda a, m: _then(a, m["map"])))
    above = _entered(checkpointed(wide.select(*keys, F.col("up").alias("block"), every.alias("map"))), keys, accept, bits)
    named = above.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("block").alias("__up"), "enter")
    same = F.col("up") == F.col("__up")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    runs = F.aggregate("maps", F.struct(F.col("enter").alias("now"), F.expr(f"cast(array() as array<struct<block:bigint,enter:{_STATE}>>)").alias("seen")), lambda a, m: F.struct(_then(a["now"], m["map"]).alias("now"), F.array_append(a["seen"], F.struct(m["block"].alias("block"), a["now"].alias("enter"))).alias("seen")))
    return wide.join(named, same).select(*keys, F.explode(runs["seen"]).alias("x")).select(*keys, "x.block", "x.enter")


def regions(rows: DataFrame, keys: Sequence[str], order: Sequence[str], symbol: str, ref: str, machine: Automaton, bits: int = BLOCK_BITS) -> DataFrame:
    """keys, start, stop: ``ref`` (an integer) of the first and last row of each region, from left to right, none overlapping.

    Rows are in ``order`` within ``keys``, which tells them apart; null keys are a key. A null symbol is none of those named. 2^bits rows are a block.
    """
    if bits < 1:
        raise ValueError("a block has two rows at least")
    index = F.lit(len(machine.symbols) - 1)
    for i, x in enumerate(machine.symbols[:-1]):
        index = F.when(F.col(symbol) == x, i).otherwise(index)
    numbered = ordered.numbered(rows.select(*dict.fromkeys([*keys, *order, symbol, ref])), keys, order, "__place")
    row = F.struct("__place", index.alias("symbol"), F.col(ref).cast("bigint").alias("ref"))
    blocks = numbered.groupBy(*keys, F.shiftright(F.col("__place") - 1, bits).alias("block")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    blocks = checkpointed(blocks)
    maps = checkpointed(blocks.select(*keys, "block", _mapped(machine, F.col("rows")).alias("map")))
    enter = _entered(maps, keys, machine.accept, bits).select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("block").alias("__b"), "enter")
    same = F.col("block") == F.col("__b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))

    def run(so_far: Column, row: Column) -> Column:
        state, began, ended = _stepped(machine, so_far["now"], row)
        idle = ended | (state == 0)
        now = F.struct(F.when(idle, 0).otherwise(state).alias("state"), F.when(~idle, began).alias("began")).cast(_STATE)
        found = F.when(ended, F.array_append(so_far["found"], F.struct(began.alias("start"), row["ref"].alias("stop")))).otherwise(so_far["found"])
        return F.struct(now.alias("now"), found.alias("found"))

    first = F.struct(F.col("enter").alias("now"), F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("found"))
    return blocks.join(enter, same).select(*keys, F.explode(F.aggregate("rows", first, run)["found"]).alias("x")).select(*keys, "x.start", "x.stop")
