"""Operators of audits: padded joins, divergence, percentages, deltas, ordered sets, first matches and levels of a graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from . import ordered


def pad_zip(left: DataFrame, right: DataFrame, key: str, left_order: Sequence[str], right_order: Sequence[str], fill: int) -> DataFrame:
    """Rows of both sides paired by place within a key; where one side is shorter, its columns are ``fill``, and nulls of its rows stay nulls.

    Rows that tie in their order are paired in any order; rows of a null key have no partner.
    """
    a = ordered.numbered(left, [key], left_order).withColumn("__a", F.lit(True))
    b = ordered.numbered(right, [key], right_order).withColumn("__b", F.lit(True))
    out = a.join(b, [key, "place"], "full_outer")
    fills = {c: F.when(F.col(side).isNull(), F.lit(fill)).otherwise(F.col(c)) for side, frame in (("__a", left), ("__b", right)) for c in frame.columns if c != key}
    return out.withColumns(fills).drop("__a", "__b")


def diverging(rows: DataFrame, key: str, outcome: str) -> DataFrame:
    """Keys with more than one outcome, and how many they have. Nulls are no outcome."""
    return rows.groupBy(key).agg(F.count_distinct(outcome).alias("outcomes")).where("outcomes > 1")


def percent(good: Column) -> Column:
    """Share of rows in per cent with one decimal; 0 of no rows."""
    return F.coalesce(F.round(F.count_if(good) * F.lit(100.0) / F.nullif(F.count(F.lit(1)), F.lit(0)), 1), F.lit(0.0))


def delta(rows: DataFrame, keys: Sequence[str], after: str) -> DataFrame:
    """keys, delta: rows after less rows before, where they differ. One aggregation takes both sides."""
    change = F.sum(F.when(F.col(after), 1).otherwise(-1).cast("bigint"))
    return rows.groupBy(*keys).agg(change.alias("delta")).where("delta <> 0")


def first_order(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, value: its distinct values in the order of their first appearance."""
    firsts = rows.groupBy(key, value).agg(F.min(order).alias("at"))
    return firsts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias(value))


def first_true(guards: Sequence[str]) -> Column:
    """The number of the first guard that holds, or -1."""
    out = F.lit(-1)
    for i, guard in reversed(list(enumerate(guards))):
        out = F.when(F.expr(guard), i).otherwise(out)
    return out.cast("bigint")


def known_place(name: Column, known: Sequence[str]) -> Column:
    """The place of a name in a known order; other names come after all of them."""
    place = F.array_position(F.lit(list(known)), name)
    return F.when(place > 0, place).otherwise(len(known) + 1)


def changed(fields: Sequence[str], then: str) -> Column:
    """Names of the fields that differ from those of the struct ``then``, comma-joined; nulls are equal to each other."""
    return F.concat_ws(",", *[F.when(~F.col(f).eqNullSafe(F.col(f"{then}.{f}")), F.lit(f)) for f in fields])


def levels(edges: DataFrame, most: int) -> DataFrame:
    """node, level: the longest path from a node without predecessors, by rounds of joins.

    Raises ValueError if paths are longer than ``most``, which a cycle's always are.
    """
    edges = checkpointed(edges.select("src", "dst"))
    starts = edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    known = front = checkpointed(starts.withColumn("level", F.lit(0).cast("bigint")))
    if front.isEmpty() and not edges.isEmpty():
        raise ValueError("the graph has a cycle")
    for level in range(1, most + 2):
        after = front.select("node").join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = checkpointed(after.withColumn("level", F.lit(level).cast("bigint")))
        if front.isEmpty():
            return known.groupBy("node").agg(F.max("level").alias("level"))
        known = known.unionByName(front)
    raise ValueError("the graph has a cycle or a longer path")
