"""Vector operators on arrays of lanes: maps, shuffles, masks, ordered and balanced reductions.

A null vector gives null, a null lane makes the lane it meets null, and of vectors of different lengths the shorter one counts as padded with nulls. Lanes
that aren't there are an error. Everything is one projection; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def zipped(a: Column, b: Column, op: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, op)


def shuffled(a: Column, b: Column, mask: list[int]) -> Column:
    """Lanes of both sources by a mask of places in their concatenation."""
    both = F.concat(a, b)
    return F.array(*[F.element_at(both, i + 1) for i in mask])


def inserted(v: Column, place: int, value: Column) -> Column:
    return F.transform(v, lambda x, i: F.when(i == place, value).otherwise(x))


def chosen(mask: Column, a: Column, b: Column) -> Column:
    """Lane-wise select."""
    return F.transform(F.arrays_zip(mask.alias("m"), a.alias("a"), b.alias("b")), lambda z: F.when(z.m, z.a).otherwise(z.b))


def folded(v: Column, start: Column, op: Callable[[Column, Column], Column]) -> Column:
    """A left fold over the lanes, in their order."""
    return F.aggregate(v, start, op)


def balanced(v: Column, width: int, op: Callable[[Column, Column], Column]) -> Column:
    """A balanced tree over a power of two of lanes: halves are combined until one lane is left."""
    n = width
    while n > 1:
        n //= 2
        v = F.zip_with(F.slice(v, 1, n), F.slice(v, n + 1, n), op)
    return v[0]


def by_block(v: Column, mask: list[int]) -> Column:
    """Each block of as many lanes as ``mask`` by the mask: a lane takes the one of that number of its block; -1: its own."""
    n, places = len(mask), F.lit(mask)

    def taken(x: Column, i: Column) -> Column:
        to = places[F.pmod(i, F.lit(n))]
        return F.when(to < 0, x).otherwise(v[i - F.pmod(i, F.lit(n)) + to])

    return F.transform(v, taken)


def mask_program(v: str, w: str, tests: list[str]) -> Column:
    """A mask from one test for each lane of a block, in SQL over x and y, the lanes of columns ``v`` and ``w``; blocks repeat the tests."""
    outcomes = F.expr(f"zip_with({v}, {w}, (x, y) -> array({', '.join(tests)}))")
    return F.transform(outcomes, lambda o, i: o[F.pmod(i, F.lit(len(tests)))])
