"""Relations that hold in a table: functional dependencies and keys level by level, and inclusions between columns.

X determines A if no two rows that agree on X differ in A, nulls being equal to each other. Two such rows of a part of the table refute it for the whole, so most
candidates go by parts; those that stand are decided on all rows. A candidate is looked at only while none of its subsets determines the same.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DateType, DecimalType, IntegralType, StringType, TimestampNTZType, TimestampType

from ..checkpoints import checkpointed

WHOLE = 1_000_000  # rows of a table that is not cut into parts
DEALT = 500_000  # rows of a task where all of them are dealt out
PART = 200_000  # rows, about, of a part that refutes
FEW = 100_000  # values of a column that are gathered before they are dealt out
_PLAIN = (BinaryType, BooleanType, DateType, DecimalType, IntegralType, StringType, TimestampNTZType, TimestampType)


def _tasks(rows: DataFrame, total: int) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // DEALT)


def _differing(rows: DataFrame, wanted: Sequence[tuple[tuple[str, ...], list[str]]], by: Sequence[str] = (), tasks: int = 0) -> dict[tuple[tuple[str, ...], str], int]:
    """(X, A) -> how many classes of X (within ``by``) have rows that differ in A; all in one job, of which a number for each (X, A) comes to the driver.

    ``tasks``: rows are dealt out by X to so many tasks.
    """
    out = None
    for i, (x, dependents) in enumerate(wanted):
        own = rows.select(*by, *x, *dependents)
        own = own.repartition(tasks, *x) if tasks and x else own
        differ = [((F.min(a) != F.max(a)) | ((F.count(a) > 0) & (F.count(a) < F.count(F.lit(1))))) for a in dependents]
        split = own.groupBy(*by, *x).agg(*[F.coalesce(d, F.lit(False)).cast("bigint").alias(f"__{k}") for k, d in enumerate(differ)])
        sums = split.agg(F.array(*[F.coalesce(F.sum(f"__{k}"), F.lit(0)) for k in range(len(dependents))]).alias("n")).select(F.lit(i).alias("i"), "n")
        out = sums if out is None else out.unionByName(sums)
    got = {r["i"]: r["n"] for r in out.collect()} if out is not None else {}
    return {(x, a): n for i, (x, dependents) in enumerate(wanted) for a, n in zip(dependents, got[i])}


def functional(rows: DataFrame, columns: Sequence[str], most: int = 2) -> DataFrame:
    """determinant (columns, comma-joined), dependent: all least functional dependencies with at most ``most`` columns on their left, which hold without exception.

    A column with one value depends on nothing, written as an empty determinant. Nulls are equal to each other. Repeated rows agree with themselves. Columns that determine
    all are keys and have a row for each other column. An empty table determines nothing, so it has no rows.

    A part is all rows whose value of a column falls into one of many buckets, so rows that agree on it stay together. What no part refutes is decided by one
    aggregation of all rows for each determinant; a table of up to WHOLE rows is one part, which decides it all.
    """
    names = sorted(columns)
    spark = rows.sparkSession
    schema = "determinant string, dependent string"
    base = rows.select(*[F.col(n) if isinstance(rows.schema[n].dataType, _PLAIN) else F.col(n).cast("string").alias(n) for n in names])
    total, *values = base.agg(F.count(F.lit(1)), *[F.approx_count_distinct(n) for n in names]).first()
    if not total:
        return spark.createDataFrame([], schema)
    buckets = total // PART if total > WHOLE else 1
    if buckets > 1:
        inside = [F.when(F.pmod(F.xxhash64(n), F.lit(buckets)) == 0, F.lit(n)) for n, v in zip(names, values) if v >= 10 * buckets]
        parts = checkpointed(base.withColumn("__part", F.explode(F.array_compact(F.array(*inside)))) if inside else base.withColumn("__part", F.lit("")).where("false"))
    else:
        parts = checkpointed(base.withColumn("__part", F.lit("")))
    found: list[tuple[tuple[str, ...], str]] = []
    for k in range(most + 1):
        wanted = [(x, [a for a in names if a not in x and not any(d == a and set(y) <= set(x) for y, d in found)]) for x in combinations(names, k)]
        wanted = [(x, dependents) for x, dependents in wanted if dependents]
        refuted = {c for c, n in _differing(parts, wanted, ["__part"]).items() if n}
        stands = [(x, left) for x, dependents in wanted if (left := [a for a in dependents if (x, a) not in refuted])]
        if buckets > 1:
            for x, left in stands:
                distinct = max([v for n, v in zip(names, values) if n in x], default=1)
                found += [c for c, n in _differing(base, [(x, left)], tasks=_tasks(rows, total) if distinct > FEW else 0).items() if not n]
        else:
            found += [(x, a) for x, left in stands for a in left]
    return spark.createDataFrame([(",".join(x), d) for x, d in found], schema) if found else spark.createDataFrame([], schema)


def inclusions(columns: Mapping[str, DataFrame]) -> DataFrame:
    """part, whole: names of columns (one-column tables) where all values of the one occur in the other; nulls are left out, and so are columns without values.

    All columns' values are gathered by value once; a value rules out every column that doesn't have it, so of each value only the set of columns that have it counts. Types
    are compared as text. Columns of FEW values are made distinct before; rows of others are dealt out to as many tasks as keep a task's values to about DEALT.
    """
    names = sorted(columns)
    counts = values = None
    for i, n in enumerate(names):
        own = columns[n].toDF("v").agg(F.count("v").alias("n"), F.approx_count_distinct("v").alias("d")).select(F.lit(i).alias("c"), "n", "d")
        counts = own if counts is None else counts.unionByName(own)
    rows, distinct = {}, {}
    for r in counts.collect():  # a row for each column
        rows[r["c"]], distinct[r["c"]] = r["n"], r["d"]
    for i, n in enumerate(names):
        own = columns[n].toDF("v").where("v is not null").select(F.col("v").cast("string").alias("v"), F.lit(i).alias("c"))
        own = own.distinct() if distinct[i] <= FEW else own
        values = own if values is None else values.unionByName(own)
    values = values.repartition(_tasks(values, sum(k for i, k in rows.items() if distinct[i] > FEW)), "v")
    sets = values.groupBy("v").agg(F.bit_or(F.expr("shiftleft(1L, c)")).alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    # for each column: the sets in which it occurs, and what they all have in common
    parts = sets.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1)))).where(F.expr("m & shiftleft(1L, c) <> 0"))
    shared = parts.groupBy("c").agg(F.bit_and("m").alias("m"))
    pairs = shared.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1)))).where(F.expr("w <> c and m & shiftleft(1L, w) <> 0"))
    label = F.lit(names)
    return pairs.select(F.get(label, F.col("c")).alias("part"), F.get(label, F.col("w")).alias("whole"))
