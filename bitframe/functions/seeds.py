"""Counter-based pseudo-random numbers as column expressions: the same on any partitioning."""

from __future__ import annotations

from .words import DUCKDB, SPARK, Dialect, Words

# Fixed values of the 32-bit mix: shifts and multipliers.
STEPS = ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None))


def mixed(seed: str, dialect: Dialect = SPARK) -> str:
    """SQL text of a 32-bit mix of ``seed`` (an unsigned number below 2^32)."""
    words = Words(32, dialect)
    at = seed
    for shift, times in STEPS:
        at = dialect.xor.format(a=f"({at})", b=dialect.shr.format(a=f"({at})", b=shift))
        if times:
            at = words.op("mul", f"({at})", f"cast({times} as bigint)")
    return at


__all__ = ["DUCKDB", "SPARK", "mixed"]
