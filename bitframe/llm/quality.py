"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Every document is measured once. A sketch of a measure is its histogram at a fixed resolution of a thousandth (a tenth of a
character for word lengths), so it has 1,001 bins at most, merges by adding counts, and gives the same quantiles in any
order of merging; Spark's own mergeable sketches are approximate, and their results couldn't be checked by SQL. Average word lengths
of 100 characters and more share the last bin. Groups of a language and a source with fewer than ``LEAST`` documents take the merged sketch of their
language, and languages with fewer take the merged sketch of all. Thresholds are joined back to filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .scratch import arrow, written

LEAST = 50
#: Measure, unit of its bins, the least distance from the median in bins that is out of range, below and above; None: that side is free.
MEASURES = {"symbols": (None, 50), "dup_lines": (None, 400), "repeats": (None, 350), "word_length": (20, 30)}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def count_block(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The six counts of each text of a block."""
    n = len(offsets) - 1
    starts, ends, first = kernel.word_spans(data, offsets)
    hashes = kernel.word_hashes(data, starts, ends)
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    space = kernel._SPACE[data]
    chars = sums(~space & ((data & 0xC0) != 0x80))
    grams, at = kernel.windows(hashes, first, 3)
    owner = np.repeat(np.arange(n), np.diff(at))
    _, back, often = np.unique(kernel.mix(grams + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    begins = np.flatnonzero(often[back] > 1) if len(grams) else np.zeros(0, np.int64)
    word = begins - at[owner[begins]] + first[owner[begins]]
    repeated = np.zeros(len(starts) + 1, bool)
    for j in range(3):
        repeated[word + j] = True
    repeats = np.diff(np.concatenate([[0], np.cumsum(repeated)])[first])
    a, b, line = kernel.word_spans(data, offsets, _NEWLINE)
    filled = np.searchsorted(starts, b) > np.searchsorted(starts, a)
    of = np.repeat(np.arange(n), np.diff(line))
    keys = kernel.mix(kernel.word_hashes(data, a, b) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, one = np.unique(keys[filled], return_index=True)
    lines = np.bincount(of[filled], minlength=n)
    distinct = np.bincount(of[filled][one], minlength=n)
    return [np.diff(first), chars, sums(_SYMBOL[data]), lines - distinct, repeats, lines]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source and the counts, of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in kernel.text_blocks(batch.column(3)):
                counts = count_block(data, offsets)
                yield pa.RecordBatch.from_arrays([c.slice(row, len(offsets) - 1) for c in batch.columns[:3]] + [pa.array(c.astype(np.int64)) for c in counts], ["doc_id", "lang", "source", *_COUNTS])

    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return arrow(plain, run, "doc_id bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in _COUNTS))


def binned(counts: DataFrame) -> DataFrame:
    """The measures as whole bins."""
    per = lambda a, b, unit: F.expr(f"least(1000, ({unit} * {a}) div greatest({b}, 1))")
    return counts.withColumns({"symbols": per("n_symbols", "word_chars", 1000), "dup_lines": per("n_dup_lines", "n_lines", 1000), "repeats": per("n_repeat_words", "n_words", 1000), "word_length": per("word_chars", "n_words", 10)})


def sketches(bins: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n: one sketch per language, source and measure."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("bin")) for m in MEASURES])
    return bins.select("lang", "source", F.explode(pairs).alias("x")).groupBy("lang", "source", "x.measure", "x.bin").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, *by: str) -> DataFrame:
    """by, measure, total, q1, q2, q3 of merged sketches: the least bin that holds a quarter, a half, three quarters of all."""
    merged = sketch.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))
    whole, so_far = Window.partitionBy(*by, "measure"), Window.partitionBy(*by, "measure").orderBy("bin")
    placed = merged.withColumns({"total": F.sum("n").over(whole), "upto": F.sum("n").over(so_far)})
    return placed.groupBy(*by, "measure").agg(F.max("total").alias("total"), *[F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bin"))).alias(f"q{k}") for k in (1, 2, 3)])


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source, and low and high of each measure; a row for each language and source that occurs."""
    own = quartiles(sketch, "lang", "source")
    of_lang = quartiles(sketch, "lang").select(F.col("lang").alias("l"), F.col("measure").alias("m"), *[F.col(c).alias(f"l_{c}") for c in ("total", "q1", "q2", "q3")])
    of_all = quartiles(sketch).select(F.col("measure").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("q1", "q2", "q3")])
    both = own.join(of_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m"))).join(of_all, F.col("measure") == F.col("a"))
    q = {c: F.when(F.col("total") >= LEAST, F.col(c)).when(F.col("l_total") >= LEAST, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}")) for c in ("q1", "q2", "q3")}
    both = both.select("lang", "source", "measure", q["q2"].alias("q2"), (3 * (q["q3"] - q["q1"])).alias("reach"))
    pick = lambda m, side: F.max(F.when(F.col("measure") == m, side))
    out = []
    for m, (below, above) in MEASURES.items():
        out += [pick(m, F.col("q2") - F.greatest(F.col("reach"), F.lit(below))).alias(f"{m}_low")] if below else []
        out += [pick(m, F.col("q2") + F.greatest(F.col("reach"), F.lit(above))).alias(f"{m}_high")]
    return both.groupBy("lang", "source").agg(*out)


def judge(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id, lang, source, counts, base_failed, kept: one row per row of ``docs``.

    base_failed: fewer than 50 words, or more than half of the words in repeated three-word windows. kept: not base_failed,
    and no measure further from its group's median than three quartile distances and a floor. A null text has no words, so
    it fails; null languages and sources are groups of their own. Repeated rows are measured and counted each. Other
    columns of ``docs`` are ignored.
    """
    bins = written(binned(measure(docs, **columns)))
    limits = thresholds(sketches(bins)).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    joined = bins.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fits = F.lit(True)
    for m, (below, _) in MEASURES.items():
        fits = fits & (F.col(m) <= F.col(f"{m}_high")) & ((F.col(m) >= F.col(f"{m}_low")) if below else F.lit(True))
    return joined.withColumns({"base_failed": failed, "kept": ~failed & F.coalesce(fits, F.lit(True))})


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return judge(docs).select("doc_id", *_COUNTS[:5], "base_failed", "kept")
