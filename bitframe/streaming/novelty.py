"""First occurrences, counts and sessions on a stream, with state bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, key: str, at: str, delay: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def counted(stream: DataFrame, key: str, at: str, size: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """start, key, n per tumbling window, emitted once the watermark has passed it."""
    out = stream.withWatermark(at, delay).groupBy(F.window(at, size), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), key, "n")


def sessions(stream: DataFrame, key: str, at: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """start, stop, key, n per session, which ends after ``gap`` without a row of its key."""
    out = stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), key, "n")


def lines_logged(spark: SparkSession, path: str) -> DataFrame:
    """value of the lines that are appended to a log: the streaming form of append_events()."""
    return spark.readStream.text(path)
