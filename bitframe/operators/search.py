"""Searches over finite domains: guard inference, and facts merged and checked."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def guards(domain: DataFrame, violation: str, atoms: dict[str, str], most: int = 2, met: bool = False) -> DataFrame:
    """guards, covered, leaks, works: each set of up to ``most`` atoms; it works if it holds somewhere and excludes all violations.

    One pass over the domain: each set is two conditional counts. ``met``: rows have n and met, as those of ``verify.whole``; n counts, and rows_met and leaks_met say how
    many rows of the table a set covers and which of these leak.
    """
    sets = [c for k in range(1, most + 1) for c in combinations(atoms, k)]
    holds = {"&".join(s): " and ".join(f"({atoms[a]})" for a in s) for s in sets}
    kinds = {"covered": ("c", "n", "true"), "leaks": ("l", "n", violation)} | ({"rows_met": ("m", "met", "true"), "leaks_met": ("k", "met", violation)} if met else {})
    count = lambda of, test: F.expr(f"coalesce(sum(case when {test} then {of} else 0L end), 0L)") if met else F.count_if(F.expr(test))
    counts = [count(of, f"({h}) and ({test})").alias(f"{c}{i}") for c, of, test in kinds.values() for i, h in enumerate(holds.values())]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("guards"), *[F.col(f"{c}{i}").alias(name) for name, (c, _, _) in kinds.items()]) for i, n in enumerate(holds)]))
    return domain.agg(*counts).select(rows.alias("g")).select("g.*").withColumn("works", (F.col("covered") > 0) & (F.col("leaks") == 0))


def merged_facts(facts: DataFrame) -> DataFrame:
    """name, zeros, ones, contradiction of known-bits facts (name, zeros, ones)."""
    out = facts.groupBy("name").agg(F.bit_or("zeros").alias("zeros"), F.bit_or("ones").alias("ones"))
    return out.withColumn("contradiction", F.col("zeros").bitwiseAND(F.col("ones")) != 0)
