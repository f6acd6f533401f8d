"""Text analytics: weighted pattern classification, line mining with context, decline buckets, token histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify(texts: DataFrame, key: str, text: str, signals: Mapping[str, Sequence[tuple[str, int]]], most: int = 3, least: int = 3, comments: str | None = None, hint: str | None = None) -> DataFrame:
    """key, family, score, runner_up, ambiguous: the family of the greatest sum of weight * min(hits, most); ties go to the first named.

    A score below ``least`` gives the family "unknown". Ambiguous: less than 1.5 times the runner-up. What matches ``comments`` is blanked first.
    A family whose name is in the column ``hint`` has 100 more. Null texts are empty; null hints are none.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    said = F.regexp_replace(said, comments, " ") if comments else said
    scores = []
    for place, (family, patterns) in enumerate(signals.items()):
        total = sum((w * F.least(F.regexp_count(said, F.lit(p)), F.lit(most)) for p, w in patterns), F.lit(0))
        total = total + F.when(F.contains(F.col(hint), F.lit(family)), 100).otherwise(0) if hint else total
        scores.append(F.struct(total.cast("bigint").alias("score"), F.lit(-place).alias("place"), F.lit(family).alias("family")))
    ranked = texts.select(key, F.reverse(F.array_sort(F.array(*scores))).alias("r"))
    top, second = F.col("r")[0], F.col("r")[1]
    family = F.when(top.score >= least, top.family).otherwise("unknown")
    return ranked.select(key, family.alias("family"), top.score.alias("score"), second.score.alias("runner_up"), (2 * top.score < 3 * second.score).alias("ambiguous"))


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1), line. A null text has one empty line; lines end at a line feed only."""
    return texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "line")).withColumn("line_no", (F.col("line_no") + 1).cast("bigint"))


def mined(rows: DataFrame, key: str, rules: Mapping[str, str], radius: int = 1) -> DataFrame:
    """key, line_no, rule, context_chars: lines that a rule matches, the first rule of each line, and the size of their context."""
    around = Window.partitionBy(key).orderBy("line_no").rowsBetween(-radius, radius)
    first = F.lit(None).cast("string")
    for name, pattern in reversed(list(rules.items())):
        first = F.when(F.col("line").rlike(pattern), name).otherwise(first)
    return rows.withColumns({"context_chars": F.sum(F.length("line")).over(around).cast("bigint"), "rule": first}).where("rule is not null").select(key, "line_no", "rule", "context_chars")


def tokens(texts: DataFrame, text: str, pattern: str = "[A-Za-z]+") -> DataFrame:
    """token, n over all texts, lower case; null texts have none. Counts are combined before the shuffle, so a frequent token is no hot key."""
    words = F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(pattern.replace("A-Z", "")), F.lit(0)))
    return texts.select(words.alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
