"""Intervals that nest and overlap, stabbed by points through dyadic keys: equality on (key, level, node), no range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from . import ordered


def cover(lo: Column, hi: Column) -> Column:
    """array of struct(level, node): the fewest aligned ranges [node * 2^level, (node + 1) * 2^level) that make up [lo, hi], both included; none if hi < lo.

    At a level, the lower edge rounded up and the upper one rounded down are what is left to cover; an odd lower or an odd upper edge gives a node.
    """
    levels = F.sequence(F.lit(0), F.log2(F.greatest(hi - lo + 1, F.lit(1)).cast("double")).cast("int") + 1)

    def at(k: Column) -> Column:
        a, b = -F.call_function("shiftright", -lo, k), F.call_function("shiftright", hi + 1, k)
        node = lambda odd, n: F.when((a < b) & (odd.bitwiseAND(1) == 1), F.struct(k.alias("level"), n.alias("node")))
        return F.array(node(a, a), node(b, b - 1))

    return F.when(lo <= hi, F.array_compact(F.flatten(F.transform(levels, at)))).otherwise(F.lit([]).cast("array<struct<level:int,node:bigint>>"))


def enclosing(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, lo: str, hi: str, grain: int = 1) -> DataFrame:
    """All pairs of a point and a range of its key that holds it, both ends included, with the columns of both sides, which share none but ``keys``.

    A range has at most two nodes a level, a point one for each level that occurs, so nested and overlapping ranges cost no more than their
    rows. ``grain`` makes keys coarser (units of it), which saves levels; the ends are compared exactly. Nulls meet nothing; a range that ends before it begins
    holds nothing; repeated rows make pairs of their own. A large key is dealt out by its nodes: the join sorts both sides, as neither may be broadcast:
    Spark takes points for as large as they were before their levels.
    """
    unit = lambda c: F.floor(F.col(c).cast("bigint") / grain) if grain > 1 else F.col(c).cast("bigint")
    keyed = ranges.where(F.col(lo) <= F.col(hi)).withColumns({"__a": unit(lo), "__b": unit(hi)})
    keyed = keyed.withColumn("__x", F.explode(cover(F.col("__a"), F.col("__b")))).drop("__a", "__b").withColumns({"__level": F.col("__x.level"), "__node": F.col("__x.node")}).drop("__x")
    keyed = checkpointed(keyed)
    levels = sorted(r[0] for r in keyed.select("__level").distinct().collect())  # 64 numbers at most
    nodes = F.explode(F.lit(levels).cast("array<int>"))
    up = points.withColumn("__level", nodes).withColumn("__node", F.call_function("shiftright", unit(at), F.col("__level")))
    return up.join(keyed.hint("merge"), [*keys, "__level", "__node"]).where(F.col(at).between(F.col(lo), F.col(hi))).drop("__level", "__node")


def innermost(pairs: DataFrame, point: Sequence[str], lo: str, hi: str, carry: Sequence[str]) -> DataFrame:
    """point, n (ranges around it), lo, hi, carry of the shortest: of equal lengths the one that begins last, then that of the least ``carry``. Combined before the shuffle."""
    best = F.min(F.struct((F.col(hi) - F.col(lo)).alias("length"), (-F.col(lo)).alias("begin"), *carry, F.col(lo).alias("__lo"), F.col(hi).alias("__hi")))
    out = pairs.groupBy(*point).agg(F.count(F.lit(1)).alias("n"), best.alias("b"))
    return out.select(*point, "n", F.col("b.__lo").alias(lo), F.col("b.__hi").alias(hi), *[F.col(f"b.{c}").alias(c) for c in carry])


def gaps(rows: DataFrame, keys: Sequence[str], at: str, tie: Sequence[str], most: int) -> DataFrame:
    """keys, lo, hi, n: stretches of a key's rows in which no two neighbours are more than ``most`` apart. Rows of a null place are left out."""
    rows = rows.where(F.col(at).isNotNull()).select(*keys, at, *tie)
    order = [at, *tie]
    seen = ordered.carried(rows, keys, order, F.col(at), "__last", own=False)
    new = F.when(F.col("__last").isNull() | (F.col(at) - F.col("__last") > most), 1).otherwise(0)
    told = ordered.summed(seen, keys, order, {"__no": new})
    return told.groupBy(*keys, "__no").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count(F.lit(1)).alias("n")).drop("__no")
