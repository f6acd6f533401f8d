"""Canonical forms of trees: digests bottom up, level by level, that don't depend on the order of children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed


def _number(*parts: Column) -> Column:
    """Two independent 64-bit hashes as a struct; sums of them, as decimals, are a digest of a multiset."""
    return F.struct(F.xxhash64(*parts).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(1), *parts).cast("decimal(38,0)").alias("b"))


def canonical(nodes: DataFrame, tree: str, node: str, parent: str, depth: str, label: str) -> DataFrame:
    """``nodes`` with ``size`` (nodes of the subtree) and ``shape`` (a digest): two subtrees have equal shapes if labels and children agree, in any order.

    A level's children are added up by parent before they are shuffled, so a node of a million children is no hot key; each round works on the
    nodes of one depth only. Nodes of a null parent are roots. A null label is a label; (tree, node) are different.
    """
    deepest = nodes.agg(F.max(depth)).first()[0] or 0
    below, done = None, []
    for level in range(deepest, 0, -1):
        own = nodes.where(F.col(depth) == level)
        if below is None:
            own = own.withColumns({"__n": F.lit(0).cast("bigint"), "__a": F.lit(0).cast("decimal(38,0)"), "__b": F.lit(0).cast("decimal(38,0)"), "__k": F.lit(0).cast("bigint")})
        else:
            sums = below.groupBy(F.col(tree).alias("__t"), F.col(parent).alias("__p")).agg(F.sum("size").alias("__n"), F.sum("shape_a").alias("__a"), F.sum("shape_b").alias("__b"), F.count(F.lit(1)).alias("__k"))
            own = own.join(sums, F.col(tree).eqNullSafe(F.col("__t")) & (F.col(node) == F.col("__p")), "left").drop("__t", "__p")
            own = own.withColumns({c: F.coalesce(c, F.lit(0).cast(t)) for c, t in (("__n", "bigint"), ("__a", "decimal(38,0)"), ("__b", "decimal(38,0)"), ("__k", "bigint"))})
        shape = _number(F.coalesce(F.col(label).cast("string"), F.lit("\x00")), F.col("__k"), F.col("__a").cast("decimal(38,0)"), F.col("__b").cast("decimal(38,0)"))
        below = checkpointed(own.withColumn("__shape", shape).select(*nodes.columns, (F.col("__n") + 1).alias("size"), F.col("__shape.a").alias("shape_a"), F.col("__shape.b").alias("shape_b")))
        done.append(below)
    if not done:
        return nodes.withColumns({"size": F.lit(0).cast("bigint"), "shape": F.lit("")}).limit(0)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(*nodes.columns, "size", F.concat_ws(":", "shape_a", "shape_b").alias("shape"))


def repeated(shaped: DataFrame, tree: str, place: str, label: str, least: int = 2) -> DataFrame:
    """label, size, copies, trees, first (tree, place of the smallest) of each shape that occurs ``least`` times and more."""
    out = shaped.groupBy("shape").agg(F.first(label).alias(label), F.first("size").alias("size"), F.count(F.lit(1)).alias("copies"), F.count_distinct(tree).alias("trees"), F.min(F.struct(tree, place)).alias("at"))
    return out.where(F.col("copies") >= least).select(label, "size", "copies", "trees", F.col(f"at.{tree}").alias("first_tree"), F.col(f"at.{place}").alias("first_place"))
