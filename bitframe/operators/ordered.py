"""Numbers, sums, carried and following values in the order of rows within keys, where one key may hold a third of all rows.

Rows are counted by key first, in sums that are combined before the shuffle. Keys that fit a task's share are served by one window for each key. Rows
of larger keys are dealt out by ranges of key and order, so that a key spans several ranges: what a window needs is computed within each (key,
range), and what goes over from range to range follows from one row for each of them. Results don't depend on which way a key goes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed

_RANGE = "__range"
LARGE = 10_000  # rows that a key may have in one window, however few rows there are in all


def _dealt(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with the number of their range, written: bounds of ranges are samples, which may be others when a task runs again."""
    return checkpointed(rows.repartitionByRange(*keys, *order).withColumn(_RANGE, F.spark_partition_id()))


def _same(keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return same


def _joined(rows: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``small`` (keys, range, ...), null keys equal."""
    names = [*keys, _RANGE]
    return rows.join(small.withColumnsRenamed({k: f"__k_{k}" for k in names}), _same(names), "left").drop(*[f"__k_{k}" for k in names])


def by_size(rows: DataFrame, keys: Sequence[str], plain: Callable[[DataFrame], DataFrame], wide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``plain`` of the rows of ordinary keys with ``wide`` of those of keys with more rows than a task should have (LARGE, or two tasks' shares)."""
    if not keys:
        return wide(rows)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total, most = counts.agg(F.sum("__n"), F.max("__n")).first()
    bound = max(LARGE, 2 * (total or 0) // int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if (most or 0) <= bound:
        return plain(rows)
    large = checkpointed(counts.where(F.col("__n") > bound).select(*[F.col(k).alias(f"__k_{k}") for k in keys]))
    ordinary, rest = rows.join(large, _same(keys), "left_anti"), rows.join(large, _same(keys), "left_semi")
    return plain(ordinary).unionByName(wide(rest))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "place", total: str | None = None) -> DataFrame:
    """``rows`` with their number from 1 in ``order`` within ``keys`` and, if named, how many rows the key has.

    Rows that are equal in keys and order get numbers in any order; null keys are a key, nulls come first. Names that begin with two underscores are ours.
    """

    def plain(rows: DataFrame) -> DataFrame:
        out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
        return out.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*keys))) if total else out

    def wide(rows: DataFrame) -> DataFrame:
        dealt = _dealt(rows, keys, order)
        sizes = dealt.groupBy(*keys, _RANGE).agg(F.count(F.lit(1)).alias("__n"))
        by = Window.partitionBy(*keys)
        sizes = sizes.select(*keys, _RANGE, (F.sum("__n").over(by.orderBy(_RANGE)) - F.col("__n")).alias("__before"), F.sum("__n").over(by).alias("__total"))
        placed = dealt.withColumn("__here", F.row_number().over(Window.partitionBy(*keys, _RANGE).orderBy(*order)))
        out = _joined(placed, checkpointed(sizes), keys).withColumn(name, (F.col("__here") + F.col("__before")).cast("bigint"))
        out = out.withColumn(total, F.col("__total")) if total else out
        return out.drop(_RANGE, "__here", "__before", "__total")

    return by_size(rows, keys, plain, wide)


def summed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """``rows`` with running sums up to and with each row; ``order`` has to tell rows of a key apart. Nulls add nothing; a sum of none is null."""
    upto = (Window.unboundedPreceding, 0)
    plain = lambda rows: rows.withColumns({n: F.sum(v).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)) for n, v in sums.items()})

    def wide(rows: DataFrame) -> DataFrame:
        dealt = _dealt(rows.withColumns({f"__v_{n}": v for n, v in sums.items()}), keys, order)
        whole = dealt.groupBy(*keys, _RANGE).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in sums])
        before = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
        whole = checkpointed(whole.select(*keys, _RANGE, *[F.sum(f"__s_{n}").over(before).alias(f"__b_{n}") for n in sums]))
        here = Window.partitionBy(*keys, _RANGE).orderBy(*order).rowsBetween(*upto)
        out = _joined(dealt.withColumns({f"__h_{n}": F.sum(f"__v_{n}").over(here) for n in sums}), whole, keys)
        both = {n: F.coalesce(F.col(f"__b_{n}") + F.col(f"__h_{n}"), f"__b_{n}", f"__h_{n}") for n in sums}
        return out.withColumns(both).drop(_RANGE, *[f"__{x}_{n}" for x in "vbh" for n in sums])

    return by_size(rows, keys, plain, wide)


def carried(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, own: bool = True) -> DataFrame:
    """``rows`` with the last value that isn't null at or before them (not ``own``: before them) in ``order`` within ``keys``; ``order`` has to tell rows with values apart."""
    upto = (Window.unboundedPreceding, 0 if own else -1)
    plain = lambda rows: rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)))

    def wide(rows: DataFrame) -> DataFrame:
        dealt = _dealt(rows.withColumn("__value", value), keys, order)
        at = F.when(F.col("__value").isNotNull(), F.struct(F.lit(1), *order))  # rows of a null value don't count
        ends = dealt.groupBy(*keys, _RANGE).agg(F.max_by("__value", at).alias("__end"))
        before = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
        ends = checkpointed(ends.select(*keys, _RANGE, F.last("__end", ignorenulls=True).over(before).alias("__earlier")))
        here = Window.partitionBy(*keys, _RANGE).orderBy(*order).rowsBetween(*upto)
        out = _joined(dealt.withColumn("__last", F.last("__value", ignorenulls=True).over(here)), ends, keys)
        out = out.withColumn("__value", F.coalesce("__last", "__earlier")).drop("__last", "__earlier", _RANGE)
        return out.withColumn(name, F.col("__value")).drop("__value")  # last, as callers name columns of theirs like ours

    return by_size(rows, keys, plain, wide)


def followed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the value (a struct, if nulls in it matter) of the next row in ``order`` within ``keys``; null for the last one."""
    plain = lambda rows: rows.withColumn(name, F.lead(value).over(Window.partitionBy(*keys).orderBy(*order)))

    def wide(rows: DataFrame) -> DataFrame:
        dealt = _dealt(rows.withColumn("__value", F.struct(value.alias("v"))), keys, order)
        starts = dealt.groupBy(*keys, _RANGE).agg(F.min_by("__value", F.struct(*order)).alias("__start"))
        starts = checkpointed(starts.select(*keys, _RANGE, F.lead("__start").over(Window.partitionBy(*keys).orderBy(_RANGE)).alias("__later")))
        out = _joined(dealt.withColumn("__next", F.lead("__value").over(Window.partitionBy(*keys, _RANGE).orderBy(*order))), starts, keys)
        return out.withColumn(name, F.coalesce("__next", "__later")["v"]).drop("__value", "__next", "__later", _RANGE)

    return by_size(rows, keys, plain, wide)
