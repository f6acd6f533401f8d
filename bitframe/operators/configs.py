"""Configuration rows: their fields, seeds, normal forms, mutants, children, patches and text form, as projections."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seeds
from ..functions.words import SPARK, Dialect

# Fields in their order, each with its number of values; constants lie from -8 to 8.
FIELDS = {
    "arith_opcode": 6, "rhs_mode": 4, "extra_opcode": 6, "predicate": 4, "shape": 5, "feature_bits": 8, "memory_shape": 6, "pointer_mode": 3, "store_mode": 3, "load_use_mode": 3,
    "loop_shape": 5, "loop_trip_mode": 3, "induction_mode": 3, "loop_use_mode": 3, "vector_shape": 25, "global_shape": 4, "compose_bits": 64, "int_width": 4, "scalar_args": 3,
    "pointer_args": 3, "pointer_noalias": 2, "cast_mode": 8, "const_a": 17, "const_b": 17,
}
CONSTANTS = ("const_a", "const_b")
# The default row, where it isn't 0, and what is added to a seed for each field.
DEFAULTS = {"feature_bits": 1, "int_width": 2, "const_b": 1}
SALTS = dict(zip(FIELDS, (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 17, 18, 19, 20, 21, 22, 23, 24, 15, 16)))


def default() -> dict[str, int]:
    return {f: DEFAULTS.get(f, 0) for f in FIELDS}


def normal(field: str, value: str) -> str:
    """SQL text of a field's normal form: its residue, or a constant folded into -8 to 8. ``value`` may be negative or null."""
    if field in CONSTANTS:
        return f"(case when {value} between -8 and 8 then {value} else (({value} % 17 + 17) % 17) - 8 end)"
    n = FIELDS[field]
    return f"(({value} % {n} + {n}) % {n})"


def of_seed(field: str, seed: str, dialect: Dialect = SPARK) -> str:
    """SQL text of a field of the row of a seed: bytes of a mix for kinds, signed 32 bits for constants."""
    mixed = seeds.mixed(f"(({seed} + {SALTS[field]}) & 4294967295)", dialect)
    raw = f"(({mixed}) - case when ({mixed}) >= 2147483648 then 4294967296 else 0 end)" if field in CONSTANTS else f"(({mixed}) & 255)"
    return f"cast({normal(field, raw)} as bigint)"


def seeded(ids: DataFrame, seed: str) -> DataFrame:
    """``ids`` with the 24 fields of the row of each seed (an unsigned number below 2^32)."""
    return ids.selectExpr("*", *[f"{of_seed(f, seed)} as {f}" for f in FIELDS])


def chosen(field: str, *keys: str, dialect: Dialect = SPARK) -> str:
    """SQL text of a uniform value of a field by a mix of counters: the same on any partitioning."""
    at = "((" + " + ".join(f"({k}) * {(2 * i + 1) * 40503}" for i, k in enumerate(keys)) + f" + {SALTS[field] * 65537}) & 4294967295)"
    low = " - 8" if field in CONSTANTS else ""
    return f"cast(({seeds.mixed(at, dialect)}) % {FIELDS[field]}{low} as bigint)"


def draws(row: str, generation: int, dialect: Dialect = SPARK) -> list[str]:
    """SQL texts of the columns d0 to d3 that mutated() reads: how many fields change, and which."""
    return [f"({seeds.mixed(f'((({row}) * 7919 + {generation * 104729 + k * 1299709}) & 4294967295)', dialect)}) as d{k}" for k in range(4)]


def mutated(field: str, row: str, generation: int, dialect: Dialect = SPARK) -> str:
    """SQL text of a field of a mutant, beside the columns of draws(): one to three fields get a new value."""
    at = list(FIELDS).index(field)
    hits = " or ".join(f"(d0 % 3 >= {k} and d{k + 1} % {len(FIELDS)} = {at})" for k in range(3))
    return f"case when {hits} then {chosen(field, row, str(generation), dialect=dialect)} else {field} end"


def mutants(rows: DataFrame, row: str, generation: int) -> DataFrame:
    """row and the fields of a mutant of each row; ``row`` numbers them."""
    return rows.selectExpr("*", *draws(row, generation)).selectExpr(row, *[f"{mutated(f, row, generation)} as {f}" for f in FIELDS])


def mutants_sql(rows: str, row: str, generation: int, dialect: Dialect) -> str:
    """The same as SQL over a subquery."""
    drawn = f"select *, {', '.join(draws(row, generation, dialect))} from {rows}"
    return f"select {row}, {', '.join(f'{mutated(f, row, generation, dialect)} as {f}' for f in FIELDS)} from ({drawn})"


def crossed(field: str, row: str, dialect: Dialect = SPARK) -> str:
    """SQL text of a child's field: of the first parent's column or of the second's (with ``_2``), each as likely."""
    toss = seeds.mixed(f"((({row}) * 15485863 + {SALTS[field]}) & 4294967295)", dialect)
    return f"case when ({toss}) % 2 = 0 then {field} else {field}_2 end"


def patched(patch: Mapping[str, int]) -> dict[str, int]:
    """The default row with a patch laid over it."""
    return default() | dict(patch)


def as_text() -> Column:
    """key=value lines in the order of the fields."""
    return F.concat(*[F.concat(F.lit(f"{f}="), F.col(f).cast("string"), F.lit("\n")) for f in FIELDS])


def written_text(rows: DataFrame, path: str) -> None:
    """A row each as key=value lines; rows are parted by an empty line."""
    rows.select(as_text().alias("value")).write.text(path)
