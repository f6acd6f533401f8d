"""State across runs: a stream's batches add to a table of versions, each of them once however often it is tried."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def state(spark: SparkSession, path: str, key: str, value: str, kinds: str, before: int | None = None) -> DataFrame:
    """key, value: the least value of each key in the versions of ``path``, or in those before a batch; none, if there are none. ``kinds``: the columns' types as DDL."""
    try:
        found = spark.read.schema(f"{kinds}, batch bigint").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kinds)
    found = found if before is None else found.where(F.col("batch") < before)
    return found.groupBy(key).agg(F.min(value).alias(value))


def adding(path: str, key: str, value: str, features: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """What foreachBatch() is to do: write the keys (``features`` of a batch: key, value) that are new, or whose value is less than any before, as the version of this batch.

    A version holds only what a batch adds, so its cost follows the batch. It depends on the versions before it alone and replaces its own folder as a whole, so a batch that is
    replayed after a failure leaves the table as it was. Batches in any order give the same state, since the least value counts. Null keys are a key; null values are left out.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = features(batch).where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value))
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema)
        known = state(spark, path, key, value, kinds, number).select(F.col(key).alias("__k"), F.col(value).alias("__v"))
        new = own.join(known, F.col(key).eqNullSafe(F.col("__k")), "left").where(F.col("__v").isNull() | (F.col(value) < F.col("__v")))
        new.select(key, value).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return add


def run(stream: DataFrame, add: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All that is there now, in batches; a later run goes on where this one ended."""
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
