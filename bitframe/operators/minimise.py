"""Reduction of real inputs: all inputs drop what they don't need in lockstep, one aggregation for a round."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed

_FOLD = {"sum": F.sum, "max": F.max, "or": F.bit_or}
_NONE = {"sum": 0, "max": None, "or": 0}  # of no items
_UPTO = (Window.unboundedPreceding, 0)


def _both(kind: str, a: Column, b: Column) -> Column:
    if kind == "max":
        return F.greatest(a, b)
    a, b = F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))
    return a + b if kind == "sum" else a.bitwiseOR(b)


def _key(keys: Sequence[str]) -> Column:
    return F.struct(*keys).alias("__key")


def reduced(items: DataFrame, keys: Sequence[str], item: str, measures: Mapping[str, tuple[str, Column]], holds: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]) -> DataFrame:
    """keys, item: what is left of each input (of ``keys``) for which a predicate holds: it still does, and without any one of them it wouldn't.

    ``measures``: name -> (kind, value of an item), kind being sum (of values that aren't negative), max or or (of bits). ``holds(m, whole)`` says of the measures
    ``m(name)`` of some items, and ``whole(name)`` of all of the input's, whether the predicate holds; it has to be monotone: what holds of some items
    holds of more. A round finds, of every input that isn't done, the shortest beginning that together with what is kept already satisfies the predicate, keeps its
    last item, which can't go, and drops all behind it. So there are as many rounds as the largest result has items, and inputs leave the rounds when they are done.
    The measures of all beginnings are computed once. Null values add nothing; null keys are a key; (keys, item) are different, and items aren't null.
    Inputs for which the predicate doesn't hold, or holds of nothing, have no rows. An input's items are numbered by one window, so they have to fit a task.
    """
    rows = items.select(_key(keys), F.col(item).alias("__item"), *[v.alias(f"v_{n}") for n, (_, v) in measures.items()])
    along, whole = Window.partitionBy("__key").orderBy("__item").rowsBetween(*_UPTO), Window.partitionBy("__key")
    rows = rows.withColumns({f"p_{n}": _FOLD[k](f"v_{n}").over(along) for n, (k, _) in measures.items()} | {f"w_{n}": _FOLD[k](f"v_{n}").over(whole) for n, (k, _) in measures.items()})
    every = lambda n: F.col(f"w_{n}")
    kept = lambda n: F.col(f"k_{n}")
    rows = checkpointed(rows.where(F.coalesce(holds(every, every), F.lit(False))))
    blank = {f"k_{n}": F.lit(_NONE[k]).cast(rows.schema[f"v_{n}"].dataType) for n, (k, _) in measures.items()}
    state = rows.groupBy("__key").agg(*[F.first(f"w_{n}").alias(f"w_{n}") for n in measures]).withColumns(blank).withColumn("__upto", F.lit(None).cast(rows.schema["__item"].dataType))
    out = []
    while True:
        state = checkpointed(state.where(~F.coalesce(holds(kept, every), F.lit(False))))
        if state.isEmpty():
            break
        met = rows.drop(*[f"w_{n}" for n in measures]).join(state, "__key").where(F.col("__upto").isNull() | (F.col("__item") < F.col("__upto")))
        enough = holds(lambda n: _both(measures[n][0], F.col(f"p_{n}"), F.col(f"k_{n}")), every)
        first = met.where(F.coalesce(enough, F.lit(False))).groupBy("__key").agg(F.min(F.struct("__item", *[f"v_{n}" for n in measures])).alias("f"), *[F.first(c).alias(c) for c in (*[f"w_{n}" for n in measures], *[f"k_{n}" for n in measures])])
        grown = {f"k_{n}": _both(k, F.col(f"k_{n}"), F.col(f"f.v_{n}")).cast(rows.schema[f"v_{n}"].dataType) for n, (k, _) in measures.items()}
        state = checkpointed(first.withColumns(grown).withColumn("__upto", F.col("f.__item")).drop("f"))
        out.append(state.select("__key", F.col("__upto").alias(item)))
    if not out:
        return items.select(*keys, item).limit(0)
    left = out[0]
    for x in out[1:]:
        left = left.unionByName(x)
    return left.select(*[F.col(f"__key.{k}").alias(k) for k in keys], item)


def minimal(items: DataFrame, left: DataFrame, keys: Sequence[str], item: str, measures: Mapping[str, tuple[str, Column]], holds: Callable) -> DataFrame:
    """keys, n_items, n_left, holds, minimal of each input in ``left`` (keys, item): does the predicate hold of what is left, and of nothing that lacks one of it?

    What an input is without an item is put together from the measures before and after it, so no pairs of items are made.
    """
    rows = items.select(_key(keys), F.col(item).alias("__item"), *[v.alias(f"v_{n}") for n, (_, v) in measures.items()])
    sizes = rows.groupBy("__key").agg(F.count(F.lit(1)).alias("n_items"), *[_FOLD[k](f"v_{n}").alias(f"w_{n}") for n, (k, _) in measures.items()])
    few = rows.join(left.select(_key(keys), F.col(item).alias("__item")), ["__key", "__item"], "left_semi").join(sizes, "__key")
    along = Window.partitionBy("__key").orderBy("__item")
    before, after = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    few = few.withColumns({f"m_{n}": _both(k, _FOLD[k](f"v_{n}").over(before), _FOLD[k](f"v_{n}").over(after)) for n, (k, _) in measures.items()})
    every = lambda n: F.col(f"w_{n}")
    few = few.withColumn("__lacking", F.coalesce(holds(lambda n: F.col(f"m_{n}"), every), F.lit(False)))
    out = few.groupBy("__key").agg(F.first("n_items").alias("n_items"), F.count(F.lit(1)).alias("n_left"), (~F.bool_or("__lacking")).alias("minimal"), *[_FOLD[k](f"v_{n}").alias(f"t_{n}") for n, (k, _) in measures.items()], *[F.first(f"w_{n}").alias(f"w_{n}") for n in measures])
    return out.select(*[F.col(f"__key.{k}").alias(k) for k in keys], "n_items", "n_left", F.coalesce(holds(lambda n: F.col(f"t_{n}"), every), F.lit(False)).alias("holds"), "minimal")
