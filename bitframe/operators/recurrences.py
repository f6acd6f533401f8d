"""Recurrences of sequences by Newton's forward differences, exact in decimals: least degree, whole coefficients and a check of every row."""

from __future__ import annotations

from collections.abc import Sequence
from math import comb, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered

DEGREE = 3
_WIDE = "decimal(38,0)"


def _powers(j: int) -> list[int]:
    """Coefficients of i * (i - 1) * ... * (i - j + 1) by powers of i."""
    out = [1]
    for k in range(j):
        out = [(out[m - 1] if m else 0) - k * (out[m] if m < len(out) else 0) for m in range(len(out) + 1)]
    return out


def _same(keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return same


def fitted(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, most: int = DEGREE) -> DataFrame:
    """keys, n, degree, multiplier, coefficients, holds: the polynomial of least degree, ``most`` or less, that a key's values follow in order; degree null: none.

    multiplier * value = the sum of coefficients[m] * i^m for the i-th row, from 0, all of them integers. A degree counts only if at least one difference more than its
    coefficients confirms it, so a key needs degree + 2 rows. ``holds`` says that every row was put in and agrees. Keys with a null value have no degree. The k-th
    difference at i is a signed sum of the values from i to i + k, which rows of ordinary keys see ahead of them; of larger keys every row adds its part to it, so that such a key is dealt out by place.
    Values are integers; ``order`` tells rows of a key apart; null keys are a key. Numbers of more than 38 digits are an error.
    """
    placed = ordered.numbered(rows.select(*dict.fromkeys([*keys, *order, value])), keys, order, "__place", "__n").withColumn("__y", F.col(value).cast(_WIDE))
    signs = {k: [(-1) ** (k - j) * comb(k, j) if j <= k else 0 for j in range(most + 2)] for k in range(most + 2)}

    def plain(placed: DataFrame) -> DataFrame:
        """Of ordinary keys: each row looks ahead within its key, so no row is shuffled again or more than once."""
        by = Window.partitionBy(*keys).orderBy("__place")
        ahead = placed.withColumns({f"__y{j}": F.lead("__y", j).over(by) for j in range(1, most + 2)}).withColumnRenamed("__y", "__y0")
        d = {k: sum((F.col(f"__y{j}") * F.lit(signs[k][j]).cast("decimal(3,0)") for j in range(1, k + 1)), F.col("__y0") * F.lit(signs[k][0]).cast("decimal(3,0)")).cast(_WIDE) for k in signs}
        terms = F.least(F.col("__n") - F.col("__place") + 1, F.lit(most + 2)).cast("bigint")
        return ahead.select(*keys, (F.col("__place") - 1).alias("__i"), "__n", terms.alias("__terms"), F.col("__y0").isNull().alias("__null"), *[v.alias(f"d{k}") for k, v in d.items()])

    def wide(placed: DataFrame) -> DataFrame:
        shift = F.explode(F.sequence(F.lit(0), F.lit(most + 1)))
        parts = placed.select(*keys, "__n", "__place", "__y", shift.alias("__j")).where("__place > __j").withColumn("__i", F.col("__place") - F.col("__j") - 1)
        sums = {f"d{k}": F.sum(F.col("__y") * F.get(F.lit(signs[k]), F.col("__j")).cast("decimal(3,0)")).cast(_WIDE) for k in signs}
        return parts.groupBy(*keys, "__i").agg(F.first("__n").alias("__n"), F.count(F.lit(1)).alias("__terms"), (F.count("__y") < F.count(F.lit(1))).alias("__null"), *[v.alias(n) for n, v in sums.items()])

    at = ordered.by_size(placed, keys, plain, wide)
    defined = {k: F.col("__terms") > k for k in range(most + 2)}  # near the end higher differences don't exist
    zero = {k: F.bool_and(F.when(defined[k], F.col(f"d{k}") == 0)) for k in range(most + 2)}
    first = [F.max(F.when(F.col("__i") == 0, F.col(f"d{k}"))).alias(f"c{k}") for k in range(most + 1)]
    of = at.groupBy(*keys).agg(F.first("__n").alias("n"), F.bool_or("__null").alias("__null"), *first, *[zero[k].alias(f"z{k}") for k in range(1, most + 2)])
    degree = F.lit(None).cast("int")
    for k in range(most, -1, -1):
        degree = F.when(F.col(f"z{k + 1}"), k).otherwise(degree)
    of = of.withColumn("degree", F.when(~F.col("__null"), degree))
    # multiplier * C(i, j) = multiplier / j! * i * (i - 1) * ... ; a sum by powers for each degree
    forms = F.lit(None).cast(f"array<{_WIDE}>")
    for d in range(most + 1):
        power = [sum((F.col(f"c{j}") * F.lit(factorial(d) // factorial(j) * _powers(j)[m]).cast("decimal(6,0)") for j in range(m, d + 1)), F.lit(0).cast("decimal(1,0)")).cast(_WIDE) for m in range(d + 1)]
        forms = F.when(F.col("degree") == d, F.array(*power)).otherwise(forms)
    times = F.when(F.col("degree").isNotNull(), F.get(F.lit([factorial(d) for d in range(most + 1)]), F.col("degree")))
    models = of.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "n", "degree", times.alias("multiplier"), forms.alias("coefficients"))
    i = (F.col("__place") - 1).cast("decimal(19,0)")
    told = F.aggregate(F.reverse("coefficients"), F.lit(0).cast(_WIDE), lambda a, c: (a * i + c).cast(_WIDE))  # Horner
    both = placed.join(models, _same(keys))
    agrees = F.bool_and(told == (F.col("__y") * F.col("multiplier")).cast(_WIDE))
    out = both.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("n", "degree", "multiplier", "coefficients")], agrees.alias("holds"))
    return out.withColumn("holds", F.when(F.col("degree").isNotNull(), F.coalesce("holds", F.lit(False))))
