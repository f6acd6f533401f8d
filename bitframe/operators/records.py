"""Record pipelines: lookup, positional, pattern and as-of joins, roll-ups, verdict lattices, first-wins and novelty windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in a stated order; a max over structs, so it combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    top = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("top"))
    return top.select(*keys, *[F.col(f"top.{c}").alias(c) for c in (*order, *rest)])


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in a stated order."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    top = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("top"))
    return top.select(*keys, *[F.col(f"top.{c}").alias(c) for c in (*order, *rest)])


def positional(left: DataFrame, right: DataFrame, key: str, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Rows of both sides paired by their place within a key; rows without a partner go, and rows of a null key.

    Rows that tie in their order are paired in any order. The sides share no column but the key, and have none named place.
    """
    a, b = ordered.numbered(left.where(F.col(key).isNotNull()), [key], left_order), ordered.numbered(right.where(F.col(key).isNotNull()), [key], right_order)
    return a.join(b, [key, "place"])


def baseline(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key and change (new, resolved, changed, same) by a null-safe comparison of ``fields``."""
    a = old.select(F.col(key), F.struct(*fields).alias("before"), F.lit(True).alias("in_old"))
    b = new.select(F.col(key), F.struct(*fields).alias("after"), F.lit(True).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "resolved").when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, right_at: str, carry: Sequence[str]) -> DataFrame:
    """Each left row with the last right row of its key at or before it. Both sides are sorted together once; no range join.

    Of right rows at one time, the one of the greatest carried columns counts. Null keys meet each other; a right row of a null time is before
    all others. Left rows without a right one have nulls. Repeated rows stay.
    """
    gone = [c for c in left.columns if c not in (by, at)]
    a = left.select(by, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*gone).alias("__row"), F.lit(None).cast(right.select(F.struct(right_at, *carry).alias("x")).schema[0].dataType).alias("__carry"))
    b = right.select(by, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.struct(right_at, *carry).alias("__carry"))
    both = ordered.carried(a.unionByName(b), [by], ["__at", "__side", "__carry"], F.col("__carry"), "__seen").where("__side = 1")
    return both.select(by, F.col("__at").alias(at), *[F.col(f"__row.{c}").alias(c) for c in gone], *[F.col(f"__seen.{c}").alias(f"last_{c}") for c in (right_at, *carry)])


def near(left: DataFrame, right: DataFrame, by: str, a: str, b: str, reach: int) -> DataFrame:
    """Pairs of a key whose places differ by ``reach`` at most: an equi-join on buckets of that width and their neighbours.

    Null keys and places meet nothing; repeated rows make pairs of their own. A large key is dealt out by its buckets.
    """
    buckets = F.explode(F.array(*[F.floor(F.col(a) / (reach + 1)) + d for d in (-1, 0, 1)]))
    left = left.withColumn("__bucket", buckets)
    right = right.withColumn("__bucket", F.floor(F.col(b) / (reach + 1)))
    return left.join(right, [by, "__bucket"]).where(F.abs(F.col(a) - F.col(b)) <= reach).drop("__bucket")


def worst(verdict: Column, ranks: Sequence[str]) -> Column:
    """The verdict that comes first in ``ranks``, of a group."""
    place = F.array_position(F.lit(list(ranks)), verdict)
    return F.element_at(F.lit(list(ranks)), F.min(F.when(place > 0, place)).cast("int"))


def stacked(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, value, n: counts of several fields in one pass; a null or empty value counts as unset."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.nullif(F.col(f).cast("string"), F.lit("")), F.lit("unset")).alias("value")) for f in fields]))
    return rows.select(pairs.alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def novel(rows: DataFrame, key: str, features: str) -> DataFrame:
    """Rows that are the first, by key, to have at least one of their features, and how many."""
    seen = rows.select(key, F.explode(features).alias("feature"))
    return seen.groupBy("feature").agg(F.min(key).alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n_new"))


def log_bucket(x: Column) -> Column:
    """Size classes 0 to 7 with the sign kept: 0, 1, 2, up to 4, 8, 16, 64, and beyond."""
    size = F.abs(x)
    bucket = F.lit(7)
    for k, most in reversed(list(enumerate((0, 1, 2, 4, 8, 16, 64)))):
        bucket = F.when(size <= most, k).otherwise(bucket)
    return (F.signum(x.cast("double")).cast("bigint") * bucket).cast("bigint")
