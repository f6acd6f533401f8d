"""Document fingerprints from content-defined chunks.

A gear hash of the last 32 bytes finds boundaries; chunks have 32 to 256 bytes, and below the normal size of 64 a boundary
needs seven zero bits, above it five, which draws sizes together. An edit moves only the boundaries near it. A fingerprint is
the set of distinct chunks, each as 32 bits of its hash and 16 bits of its length; containment weighs chunks by length.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .scratch import arrow

LEAST, NORMAL, MOST, STRICT, LOOSE = 32, 64, 256, 7, 5
LAST = 2**63 - 1
_SEEDS = np.random.Generator(np.random.PCG64(4096))
_GEAR = _SEEDS.integers(0, 2**32, 256, dtype=np.uint32)
_BYTE = _SEEDS.integers(1, 2**64, 256, dtype=np.uint64)
_PLACE = _SEEDS.integers(0, 2**64, MOST, dtype=np.uint64) | np.uint64(1)


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts of all chunks of a block of texts, and each text's first chunk number."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):  # h[i] = sum of gear[data[i - k]] << k for k < 32
        older = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += older
    loose = np.flatnonzero((h >> np.uint32(32 - LOOSE)) == 0)
    strict = loose[(h[loose] >> np.uint32(32 - STRICT)) == 0]
    loose, strict = (loose + 1).tolist(), (strict + 1).tolist()
    starts, first = [], [0]
    for at, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        while at < end:
            starts.append(at)
            i = bisect_left(strict, at + LEAST)
            cut = strict[i] if i < len(strict) else end
            if cut >= at + NORMAL:
                i = bisect_left(loose, at + NORMAL)
                cut = min(loose[i] if i < len(loose) else end, at + MOST)
            at = min(cut, end)
        first.append(len(starts))
    return starts, first


def prints(texts: pa.Array) -> list[np.ndarray]:
    """Each text's fingerprint: its distinct chunks as sorted numbers, the length in the low 16 bits."""
    out = []
    for _, data, offsets in kernel.text_blocks(texts):
        starts, first = chunk_starts(data, offsets)
        if not starts:
            out += [np.zeros(0, np.uint64)] * (len(offsets) - 1)
            continue
        starts = np.array(starts)
        sizes = np.diff(np.append(starts, len(data)))
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        sums = kernel.mix(np.add.reduceat(_BYTE[data] * _PLACE[place], starts) + sizes.astype(np.uint64))
        keys = (sums >> np.uint64(32) << np.uint64(16)) | sizes.astype(np.uint64)
        out += [np.unique(keys[first[i] : first[i + 1]]) for i in range(len(offsets) - 1)]
    return out


def written_out(keys: np.ndarray) -> str:
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The length of shared chunks over the length of the smaller set: the greater of both containments. Empty sets are alike."""
    weigh = lambda x: int((x & np.uint64(0xFFFF)).sum())
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return weigh(np.intersect1d(a, b, assume_unique=True)) / min(weigh(a), weigh(b))


def edited(text: str, other: str) -> str:
    """The last half of ``text`` replaced by the beginning of ``other``."""
    k = len(text) // 2
    return text[: len(text) - k] + other[:k]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex of its chunks): one row per row; null texts count as empty and have an empty fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([written_out(k) for k in prints(batch.column(1))], pa.string())], ["doc_id", "fingerprint"])

    return arrow(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id bigint, fingerprint string")


def with_next(docs: DataFrame, run, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: ANN001
    """Stream (doc_id, text, next text) to ``run``, in ascending id; after the last comes the first. Texts are shuffled once.

    Ids are cut into blocks at their quantiles; the first rows of a block go to the block before it, too. Rows without an id
    come last; rows that repeat one are in the order of their texts. ``run`` takes lists of (id, text, next) and yields batches.
    """
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("at"), F.col(id_col).isNull().alias("none"), F.col(text_col).alias("text"))
    blocks = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    probe = plain.agg(F.percentile_approx("at", [i / blocks for i in range(1, blocks)], 20 * blocks)).first()[0] or []
    bounds = sorted(set(probe))

    def number(ids):  # noqa: ANN001, ANN202
        return np.searchsorted(np.array(bounds, np.int64), ids, "left")

    @F.pandas_udf(T.LongType())
    def block_of(ids):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(number(ids.to_numpy()))

    lows = sorted((r["b"], r["low"]) for r in plain.groupBy(block_of("at").alias("b")).agg(F.min("at").alias("low")).collect())
    peeks = {low: lows[i - 1][0] for i, (_, low) in enumerate(lows)}  # an id that begins a block -> the block before it

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def homes(ids):  # noqa: ANN001, ANN202
        """A row's block times two, and that of the block before it, times two plus one, if the row begins a block."""
        import pandas as pd

        own = number(ids.to_numpy())
        return pd.Series([[2 * b, 2 * peeks[i] + 1] if i in peeks else [2 * b] for i, b in zip(ids.tolist(), own.tolist())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (block, id, text) that waits for its next

        def ready(rows):  # noqa: ANN001, ANN202
            nonlocal held
            for home, at, none, text in rows:
                block, peek = home >> 1, home & 1
                if held and held[0] == block:
                    yield held[1], held[2], text
                    held = None
                if not peek:
                    held = (block, None if none else at, text)

        for batch in batches:
            texts = batch.column(3)
            for i in range(0, len(batch), 256):
                rows = zip(*[batch.column(k)[i : i + 256].to_pylist() for k in range(3)], [t or "" for t in texts[i : i + 256].to_pylist()])
                if found := list(ready(rows)):
                    yield from run(found)

    placed = plain.select(F.explode(homes("at")).alias("home"), "at", "none", "text")
    sorted_ = placed.repartition(F.shiftright("home", 1)).sortWithinPartitions(F.shiftright("home", 1), F.col("home"), F.col("at"), F.col("none"), F.col("text"))
    return arrow(sorted_, stream, schema)


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns: one row per row of ``docs``.

    Null texts are empty, and an empty text has an empty fingerprint. Rows without an id come last, in the order of their texts, as do rows that repeat an id, which
    are one block, and so one task. The only row of a table is its own next. An empty table has no rows; other columns are ignored.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(rows: list) -> Iterator[pa.RecordBatch]:
        mine, theirs = [r[1] for r in rows], [r[2] for r in rows]
        changed = [edited(a, b) for a, b in zip(mine, theirs)]
        n = len(rows)
        of = prints(pa.array([*mine, *changed], pa.large_string()))
        fresh = [i for i in range(n) if i == n - 1 or theirs[i] is not mine[i + 1]]  # most are next in the list themselves
        other = dict(zip(fresh, prints(pa.array([theirs[i] for i in fresh], pa.large_string()))))
        following = [other[i] if i in other else of[i + 1] for i in range(n)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()), pa.array([len(t) for t in mine], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array([written_out(k) for k in of[:n]]), pa.array([written_out(k) for k in of[n : 2 * n]]),
                pa.array([likeness(a, b) for a, b in zip(of[:n], of[n : 2 * n])], pa.float64()), pa.array([likeness(a, b) for a, b in zip(of[:n], following)], pa.float64()),
            ],
            names,
        )

    return with_next(docs, run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
