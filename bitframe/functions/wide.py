"""Arithmetic of 64-bit words in BIGINT, whose bits are the word's: no sum or product may overflow, so they go by halves.

A word of 2^63 and more is a negative number here. Texts are Spark SQL; ``a`` and ``b`` are texts of words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOW = "4294967295"


def low(a: str) -> str:
    return f"({a} & {_LOW})"


def high(a: str) -> str:
    return f"shiftrightunsigned({a}, 32)"


def joined(top: str, bottom: str) -> str:
    return f"(shiftleft({low(top)}, 32) | {low(bottom)})"


def add(a: str, b: str) -> str:
    bottom = f"({low(a)} + {low(b)})"
    return joined(f"({high(a)} + {high(b)} + shiftrightunsigned({bottom}, 32))", bottom)


def negated(a: str) -> str:
    return add(f"(~{a})", "1L")


def sub(a: str, b: str) -> str:
    return add(a, negated(b))


def _half_product(a: str, b: str) -> str:
    """The low 64 bits of the product of two halves, by quarters: a high half of 2^31 and more would overflow."""
    top, bottom = f"(shiftrightunsigned({a}, 16) * {b})", f"(({a} & 65535) * {b})"
    return add(f"shiftleft({top}, 16)", bottom)


def mul(a: str, b: str) -> str:
    cross = f"(({_cut(high(a), low(b))} + {_cut(low(a), high(b))}) & {_LOW})"
    return add(_half_product(low(a), low(b)), f"shiftleft({cross}, 32)")


def _cut(a: str, b: str) -> str:
    """The low 32 bits of the product of two halves."""
    return f"((((shiftrightunsigned({a}, 16) * {b}) & 65535) * 65536 + ({a} & 65535) * {b}) & {_LOW})"


def less(a: str, b: str) -> str:
    """Unsigned: the sign bit turned over, then as signed numbers."""
    flip = "cast(-9223372036854775808 as bigint)"
    return f"(({a} ^ {flip}) < ({b} ^ {flip}))"


def shifted_left(a: str, n: str) -> str:
    return f"(case when {n} >= 64 or {n} < 0 then 0L else shiftleft({a}, cast({n} as int)) end)"


def shifted_right(a: str, n: str) -> str:
    return f"(case when {n} >= 64 or {n} < 0 then 0L else shiftrightunsigned({a}, cast({n} as int)) end)"


def with_quotient(rows: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``rows`` with the unsigned quotient of two columns; all ones by zero.

    A dividend of 2^63 and more goes by its half: twice that quotient, and one more if the rest allows. Product and rest are columns of their own,
    so that their texts aren't repeated.
    """
    rows = rows.withColumn("__q", F.expr(f"case when {b} > 0 and {a} < 0 then shiftleft(shiftrightunsigned({a}, 1) div greatest({b}, 1L), 1) else 0L end"))
    rows = rows.withColumn("__p", F.expr(mul("__q", b))).withColumn("__r", F.expr(sub(a, "__p")))
    by_half = f"__q + case when {less('__r', b)} then 0L else 1L end"
    quotient = f"case when {b} = 0 then -1L when {b} < 0 then case when {less(a, b)} then 0L else 1L end when {a} >= 0 then {a} div greatest({b}, 1L) else {by_half} end"
    return rows.withColumn(out, F.expr(quotient)).drop("__q", "__p", "__r")
