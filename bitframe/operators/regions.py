"""Balanced regions by prefix sums, without a parser, and trees over them.

An opening token counts 1, a closing one -1. How deep a token stands is the sum so far less the least sum so far (a closing token that nothing is
open for changes nothing), and of one key's tokens at a depth the r-th opening belongs to the r-th closing. Tokens are dealt out by blocks of
their number, so a text of millions of tokens spreads over tasks: a block is summed up by its sum and least sum, and these compose from block to block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from .ordered import carried

BLOCK = 4096
_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, 0)


def _same(names: Sequence[str], prefix: str) -> Column:
    same = F.lit(True)
    for k in names:
        same = same & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return same


def _beside(rows: DataFrame, small: DataFrame, names: Sequence[str]) -> DataFrame:
    named = small.withColumnsRenamed({k: f"__k_{k}" for k in names})
    return rows.join(named, _same(names, "__k_"), "left").drop(*[f"__k_{k}" for k in names])


def matched(tokens: DataFrame, text: str, place: str, kinds: Sequence[str], delta: str, carry: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """text, kinds, start, stop: the places of the opening and closing token of each region, one row for each; and ``carry``, columns of the closing token.

    tokens: ``place`` orders the tokens of a text, of which there are no more than a task can hold in ``block`` places; ``delta`` is 1, -1 or 0; regions are matched among tokens of equal ``kinds`` (a null is a kind). Tokens without a
    partner have no row, nor have those of a null place or delta. A place occurs once in a text; of repeated ones, any comes first.
    """
    keys = [text, *kinds]
    rows = tokens.where(F.col(place).isNotNull() & F.col(delta).isin(1, -1)).select(*keys, F.col(place).cast("bigint").alias("__at"), F.col(delta).cast("bigint").alias("__d"), *[F.col(c).alias(f"__c_{c}") for c in carry])
    rows = rows.withColumn("__block", F.floor(F.col("__at") / block)).repartition(text, "__block")
    here = Window.partitionBy(*keys, "__block").orderBy("__at")
    rows = checkpointed(rows.withColumn("__sum", F.sum("__d").over(here.rowsBetween(*_UPTO))).withColumn("__low", F.min("__sum").over(here.rowsBetween(*_UPTO))))
    blocks = rows.groupBy(*keys, "__block").agg(F.sum("__d").alias("__s"), F.min("__sum").alias("__m"))
    along = Window.partitionBy(*keys).orderBy("__block").rowsBetween(*_BEFORE)
    blocks = blocks.withColumn("__s0", F.coalesce(F.sum("__s").over(along), F.lit(0))).withColumn("__m0", F.least(F.lit(0), F.min(F.col("__s0") + F.col("__m")).over(along)))
    rows = _beside(rows, blocks.select(*keys, "__block", "__s0", "__m0"), [*keys, "__block"])
    depth = F.col("__s0") + F.col("__sum") - F.least("__m0", F.col("__s0") + F.col("__low"))
    # a token that opens reaches its depth; one that closes leaves the depth above; one that nothing is open for stays at 0
    spare = (F.col("__d") == -1) & (F.col("__s0") + F.col("__sum") < F.least("__m0", F.coalesce(F.col("__s0") + F.lag("__low").over(here), F.col("__m0"))))
    rows = rows.withColumns({"__depth": depth - F.least("__d", F.lit(0)), "__spare": spare}).where("not __spare")
    level = [*keys, "__depth", "__d"]
    rows = checkpointed(rows.select(*level, "__block", "__at", *[f"__c_{c}" for c in carry], F.row_number().over(Window.partitionBy(*level, "__block").orderBy("__at")).alias("__r")))
    counts = rows.groupBy(*level, "__block").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__n0", F.coalesce(F.sum("__n").over(Window.partitionBy(*level).orderBy("__block").rowsBetween(*_BEFORE)), F.lit(0)))
    rows = _beside(rows, counts.select(*level, "__block", "__n0"), [*level, "__block"]).withColumn("__r", F.col("__r") + F.col("__n0"))
    ends = rows.where("__d = -1").select(*[F.col(k).alias(f"__e_{k}") for k in (*keys, "__depth", "__r")], F.col("__at").alias("stop"), *[F.col(f"__c_{c}").alias(c) for c in carry])
    starts = rows.where("__d = 1").drop(*[f"__c_{c}" for c in carry])
    return starts.join(ends, _same([*keys, "__depth", "__r"], "__e_")).select(*keys, F.col("__at").alias("start"), "stop", *carry)


def nested(regions: DataFrame, text: str, block: int = BLOCK) -> DataFrame:
    """``regions`` (text, start, stop) with ``depth``, how many of them hold their start, themselves included, and ``parent``, the start of that which stands around them.

    The parent is the last region before them that starts one level further out, null for those of depth 1. Regions that cross instead of nesting count as open
    till they stop. Starts are different within a text; rows of a null text are a text.
    """
    ends = regions.select(text, F.explode(F.array(F.struct(F.col("start").alias("__at"), F.lit(1).alias("__d")), F.struct(F.col("stop").alias("__at"), F.lit(-1).alias("__d")))).alias("x")).select(text, "x.*")
    ends = ends.withColumn("__block", F.floor(F.col("__at") / block)).repartition(text, "__block")
    sums = checkpointed(ends.withColumn("__sum", F.sum("__d").over(Window.partitionBy(text, "__block").orderBy("__at", "__d").rowsBetween(*_UPTO))))
    blocks = sums.groupBy(text, "__block").agg(F.sum("__d").alias("__s"))
    blocks = blocks.withColumn("__s0", F.coalesce(F.sum("__s").over(Window.partitionBy(text).orderBy("__block").rowsBetween(*_BEFORE)), F.lit(0)))
    starts = _beside(sums.where("__d = 1"), blocks.select(text, "__block", "__s0"), [text, "__block"])
    starts = starts.select(F.col(text).alias("__t"), F.col("__at").alias("__start"), (F.col("__s0") + F.col("__sum")).alias("depth"))
    deep = checkpointed(regions.join(starts, F.col(text).eqNullSafe(F.col("__t")) & (F.col("start") == F.col("__start"))).drop("__t", "__start"))
    # who stands around: among the starts of the level further out and those of this one, the last of the former
    both = deep.select(text, "depth", "start", F.explode(F.array(F.lit(0), F.lit(1))).alias("__outer"))
    both = both.select(text, (F.col("depth") + F.col("__outer")).alias("__level"), "start", "__outer")
    around = carried(both, [text, "__level"], ["start", "__outer"], F.when(F.col("__outer") == 1, F.col("start")), "parent").where("__outer = 0")
    around = around.select(F.col(text).alias("__t"), F.col("start").alias("__start"), "parent")
    return deep.join(around, F.col(text).eqNullSafe(F.col("__t")) & (F.col("start") == F.col("__start"))).drop("__t", "__start")


#: Comments, scripts and styles whole, so that what stands in them is no tag, then tags.
MARKUP = r"(?si)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|</?[a-z][^>]*>"


def tags(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, place (from 0), name, delta (1, -1; 0: neither), at and upto (code points before and after it) of a page's tags; null pages have none."""
    said = F.coalesce(F.col(html), F.lit(""))
    cut = pages.select(key, F.regexp_extract_all(said, F.lit(MARKUP), F.lit(0)).alias("tags"), F.transform(F.split(said, MARKUP, -1), lambda x: F.length(x)).alias("gaps"))
    # places follow from running sums within the page's arrays of lengths
    lengths = F.zip_with(F.slice("gaps", F.lit(1), F.size("tags")), F.col("tags"), lambda g, t: F.struct(g.alias("gap"), t.alias("tag")))
    rows = cut.select(key, F.posexplode(lengths).alias("place", "x")).select(key, F.col("place").cast("bigint").alias("place"), "x.gap", "x.tag")
    rows = rows.withColumn("__block", F.floor(F.col("place") / BLOCK)).repartition(key, "__block")
    here = Window.partitionBy(key, "__block").orderBy("place").rowsBetween(*_UPTO)
    name = F.lower(F.regexp_extract("tag", r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    whole = F.col("tag").rlike(r"(?si)^<(!--|script\b|style\b)") | F.col("tag").endswith("/>")
    delta = F.when(whole | (name == ""), 0).when(F.col("tag").startswith("</"), -1).otherwise(1)
    rows = checkpointed(rows.select(key, "__block", "place", name.alias("name"), delta.alias("delta"), F.length("tag").alias("__len"), F.sum(F.col("gap") + F.length("tag")).over(here).alias("__upto")))
    blocks = rows.groupBy(key, "__block").agg(F.max("__upto").alias("__s"))
    blocks = blocks.select(key, "__block", F.coalesce(F.sum("__s").over(Window.partitionBy(key).orderBy("__block").rowsBetween(*_BEFORE)), F.lit(0)).alias("__s0"))
    upto = F.col("__s0") + F.col("__upto")
    return _beside(rows, blocks, [key, "__block"]).select(key, "place", "name", "delta", (upto - F.col("__len")).alias("at"), upto.alias("upto"))


def elements(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, name, start, stop (code points, stop exclusive), depth, parent (start of the element around it): a page's elements with both their tags."""
    pairs = matched(tags(pages, key, html), key, "at", ["name"], "delta", ["upto"], 16 * BLOCK)
    return nested(checkpointed(pairs), key, 16 * BLOCK).select(key, "name", "start", F.col("upto").alias("stop"), "depth", "parent")
