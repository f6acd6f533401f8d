"""Near-duplicate documents: b-bit MinHash with band candidates, confirmed on full shingle sets.

1. Each text's set of distinct word shingles is hashed to 64 bits; equal sets form one class. All later work is on classes.
2. 160 minima give 40 band keys of four minima each, and two low bits of each minimum are packed into 40 bytes. All
   bands of a pair differ with a probability of 7e-10 at a similarity of 0.8, and 2e-13 at 0.85.
3. Classes that share a band key are candidates. A bucket of up to ``PAIRED`` classes yields its pairs. In a larger one,
   each class is paired with the bucket's pivot, the class that lies in the most large buckets. Where that doesn't tie all of a
   pivot's classes to one component, prefix filtering finds the other pairs: two sets that reach the threshold share one of
   their rarest shingles, so pages of one template, which only share what all have, meet nowhere. No pair that can reach the
   threshold is left out. Likely pairs come first; after them, pairs that are known to be of one component need no test.
4. Pairs whose collision-corrected estimate from the packed bits is more than five deviations below the threshold go; the
   rest are confirmed by the sizes of intersection and union of the full sets.
5. Connected components by alternating star contractions, each round written to the shared folder.

A band, a pivot or a hub may hold a third of all rows. What meets such a key in a join has one row for it and is written before, so
that both sides are plain shuffles, whose large partitions the adaptive planner deals out again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .scratch import arrow, written

BANDS, ROWS, BITS, PAIRED, SLOTS = 40, 4, 2, 8, 2**24
_SEEDS = np.random.Generator(np.random.PCG64(77))
_A = _SEEDS.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _SEEDS.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_MIX = _SEEDS.integers(0, 2**64, ROWS, dtype=np.uint64) | np.uint64(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The minima of a non-empty set under each of the hash functions."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(_A), 2**32 - 1, np.uint32)
    for i in range(0, len(low), 1024):
        np.minimum(best, (low[i : i + 1024, None] * _A + _B).min(0), out=best)
    return best


def pack(best: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Band keys, and the low bits of the mixed minima, packed."""
    wide = kernel.mix(best.astype(np.uint64) + np.arange(len(best), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keys = kernel.mix((wide.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    bits = (wide[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    return keys.view(np.int64), np.packbits(bits.astype(np.uint8)).view(np.int64)


def digest(hashes: np.ndarray) -> bytes:
    """128 bits of a set."""
    a = hashes.sum(dtype=np.uint64)
    b = kernel.mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    return np.array([a, b ^ np.uint64(len(hashes))], np.uint64).tobytes()


def signatures(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, key (of the set; null if empty), bands, bits, text_key (a hash of the text): one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in kernel.text_blocks(batch.column(1)):
                sets = kernel.shingle_sets(data, offsets, size)
                packed = [pack(minima(s)) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([p[0] for p in packed], pa.list_(pa.int64())),
                        pa.array([p[1] for p in packed], pa.list_(pa.int64())),
                        batch.column(2).slice(row, len(sets)),
                    ],
                    ["doc_id", "n_shingles", "key", "bands", "bits", "text_key"],
                )

    schema = "doc_id bigint, n_shingles bigint, key binary, bands array<bigint>, bits array<bigint>, text_key bigint"
    return arrow(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key")), run, schema)


def _slots(ids: np.ndarray) -> list[np.ndarray]:
    """Places of ids in a filter of SLOTS bits."""
    h = kernel.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return [(h & np.uint64(SLOTS - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(SLOTS - 1)).astype(np.int64)]


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of a fixed two megabytes over the one column of ``ids``; built in the executors, merged by words of 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_slots(batch.column(0).drop_null().to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    words = np.zeros(SLOTS // 64, np.int64)
    for r in arrow(ids, run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        words[r["word"]] = r["bits"]
    return words.view(np.uint64)


def full_sets(docs: DataFrame, passing: np.ndarray, size: int = 5) -> DataFrame:
    """key, items (the whole set), computed anew for rows that pass the filter of ids and those without an id.

    docs: doc_id, text. Rows with an empty set go; others may pass the filter by chance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            good = ~batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            good |= np.logical_and.reduce([(passing[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool) for at in _slots(ids)])
            for _, data, offsets in kernel.text_blocks(batch.column(1).filter(pa.array(good))):
                sets = [s for s in kernel.shingle_sets(data, offsets, size) if len(s)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), items], ["key", "items"])

    return arrow(docs.select("doc_id", "text"), run, "key binary, items array<bigint>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: the share of equal two-bit fields, corrected for chance collisions."""
    low = F.lit(int("01" * 32, 2))
    differ = F.lit(0)
    for i in range(BANDS * ROWS * BITS // 64):
        x = a[i].bitwiseXOR(b[i])
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(low))
    chance = 2.0**-BITS
    return (1 - differ / F.lit(float(BANDS * ROWS)) - chance) / (1 - chance)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edge list (a, b), root being a component's smallest node.

    Alternating large-star and small-star contraction; each round is written, and the rounds end when one changes nothing.
    """

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    pairs = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = mark(pairs)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        ends = F.explode(F.array_compact(F.array(F.col("u"), F.when(F.col("v") != F.col("m"), F.col("v")))))
        pairs = written(small.select(ends.alias("u"), F.col("m").alias("v")).distinct())
        if (after := mark(pairs)) == before:
            break
        before = after
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` (node, root) after more edges (a, b): only what lies between different components is contracted."""
    between = edges.select("a", "b")
    for end in ("a", "b"):
        between = between.join(roots.select(F.col("node").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    over = written(components(between))
    moved = roots.join(over.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(over.join(roots.select("node"), "node", "left_anti"))


def rare_pairs(rows: DataFrame, threshold: int) -> DataFrame:
    """(a, b): pairs of different roots that share one of their rarest shingles; every pair that reaches the threshold is among them.

    rows: key, n_shingles, root, items (the whole set). Sets are ordered by how many rows have a shingle, then by the shingle. The first
    one that both sets of a pair have comes with all others that they share behind it, so from it on either set has as many shingles
    as a pair of these two sizes has to share. Shingles of one row only come first and are in no pair.

    A shingle may stand in a third of all rows. Rows of its most frequent root aren't compared with each other, and rows too large for
    the smallest that has the shingle are left out before the join.
    """
    items = rows.select("key", F.explode("items").alias("item"))
    counts = written(items.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    lists = items.join(counts, "item").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("common"))
    spare = F.expr(f"(100 * size(common) - {threshold} * n_shingles) div 100 + 1")  # more would leave too few behind them for any partner
    lists = lists.join(rows.select("key", "n_shingles", "root"), "key").where(100 * F.size("common") >= threshold * F.col("n_shingles"))
    places = lists.select("key", "root", "n_shingles", F.size("common").cast("bigint").alias("size"), F.posexplode(F.slice("common", F.lit(1), spare.cast("int"))).alias("pos", "at"))
    places = written(places.select("key", "root", "n_shingles", F.col("at.item").alias("item"), (F.col("size") - F.col("pos")).alias("behind")))
    by_root = places.groupBy("item", "root").agg(F.count(F.lit(1)).alias("n"), F.min("n_shingles").alias("least"))
    about = by_root.groupBy("item").agg(F.max(F.struct("n", "root")).alias("top"), F.min("least").alias("least"), F.count(F.lit(1)).alias("roots"))
    about = written(about.where("roots > 1").select("item", F.col("top.root").alias("top"), "least"))
    enough = lambda behind, n, m: (100 + threshold) * F.col(behind) >= threshold * (F.col(n) + F.col(m))
    able = places.join(about, "item").where(enough("behind", "n_shingles", "least"))
    able = written(able.select("item", "key", "root", "n_shingles", "behind", (F.col("root") != F.col("top")).alias("other")))
    fits = enough("x.behind", "x.n_shingles", "y.n_shingles") & enough("y.behind", "x.n_shingles", "y.n_shingles")
    once = ~F.col("y.other") | (F.col("x.key") < F.col("y.key"))
    both = able.where("other").alias("x").join(able.alias("y"), (F.col("x.item") == F.col("y.item")) & (F.col("x.root") != F.col("y.root")) & once & fits)
    return both.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def links(docs: DataFrame, classes: DataFrame, threshold: int = 85, size: int = 5) -> tuple[DataFrame, DataFrame]:
    """Confirmed links (a, b, n_a, n_b, shared) between different classes, as many as tie all components together, and (node, root) of those components.

    docs: doc_id, text. classes: key, first_id, n_shingles, bands, bits, one row per class.
    """
    t = threshold / 100
    least = t - 5 * 1.25 * math.sqrt(t * (1 - t) / (BANDS * ROWS))
    rows = classes.select("key", F.explode("bands").alias("band"))
    counts = written(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = written(rows.join(counts, "band"))
    few, many = shared.where(F.col("n") <= PAIRED), shared.where(F.col("n") > PAIRED)
    paired = (
        few.select("band", F.col("key").alias("a")).join(few.select("band", F.col("key").alias("b")), "band")
        .where("a < b").select("a", "b").distinct()
    )

    central = many.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    pivots = many.join(central, "key").groupBy("band").agg(F.max(F.struct("c", "key")).alias("top")).select("band", F.col("top.key").alias("pivot"))
    pivots = written(pivots)
    crowd = written(many.join(pivots, "band").select("pivot", "key").distinct())
    stars = crowd.where("key <> pivot").select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct()

    involved = written(classes.select("key", "first_id", "n_shingles", "bits").join(shared.select("key").distinct(), "key", "left_semi"))
    passed = full_sets(docs, id_filter(involved.select("first_id")), size)
    sets = written(passed.join(involved.select("key"), "key", "left_semi").groupBy("key").agg(F.first("items").alias("items")))
    alone = (
        sets.join(crowd.select("key").distinct(), "key", "left_semi")
        .select("key", F.explode("items").alias("item"))
        .groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
        .where("n = 1").groupBy("key").agg(F.count(F.lit(1)).alias("alone"))
    )
    facts = written(involved.join(alone, "key", "left").select("key", "n_shingles", "bits", (F.col("n_shingles") - F.coalesce("alone", F.lit(0))).alias("common")))

    def near(pairs: DataFrame, count: str, likely: float | None = None) -> DataFrame:
        """Pairs that can reach the threshold, if at most ``count`` shingles of either are in the other; ``likely``: whether they are estimated at so much."""
        n_x, n_y, most = F.col("x.n_shingles"), F.col("y.n_shingles"), F.least(f"x.{count}", f"y.{count}")
        fits = 100 * most >= threshold * F.greatest(n_x, n_y, n_x + n_y - most)
        both = pairs.join(facts.alias("x"), F.col("x.key") == F.col("a")).join(facts.alias("y"), F.col("y.key") == F.col("b"))
        both = both.withColumn("estimate", estimate(F.col("x.bits"), F.col("y.bits"))).where(fits & (F.col("estimate") >= least))
        return both.select("a", "b", n_x.alias("n_a"), n_y.alias("n_b"), *([] if likely is None else [(F.col("estimate") >= likely).alias("likely")]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The arrays of the full sets travel only for pairs that can be links."""
        both = pairs.join(sets.select(F.col("key").alias("a"), F.col("items").alias("of_a")), "a").join(sets.select(F.col("key").alias("b"), F.col("items").alias("of_b")), "b")
        both = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("of_a", "of_b")).cast("bigint").alias("shared"))
        return both.where(100 * F.col("shared") >= threshold * (F.col("n_a") + F.col("n_b") - F.col("shared")))

    found = written(confirmed(near(paired, "n_shingles").unionByName(near(stars, "common")).distinct()))
    roots = written(components(found))
    able = crowd.join(facts, "key").where(100 * F.col("common") >= threshold * F.col("n_shingles")).select("pivot", "key", "n_shingles")
    able = written(able.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")))
    mixed = written(able.groupBy("pivot").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("pivot"))
    open_ = able.join(mixed, "pivot", "left_semi").select("key", "n_shingles", "root").distinct()
    rest = written(near(rare_pairs(open_.join(sets, "key"), threshold), "common", likely=t))
    for likely in (True, False):
        apart = rest.where(F.col("likely") == likely)
        for end in ("a", "b"):
            apart = apart.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
        apart = apart.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b", "n_a", "n_b")
        more = written(confirmed(apart))
        found, roots = found.unionByName(more), written(joined(roots, more))
    return found, roots


def _grouped(plain: DataFrame, threshold: int, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures, classes, (node, root) of the components of classes) of rows (doc_id, text)."""
    marked = written(signatures(plain, size))
    classes = written(
        marked.where("key is not null").groupBy("key")
        .agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    )
    return marked, classes, links(plain, classes, threshold, size)[1]


def near_duplicates(docs: DataFrame, threshold: int = 85, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Link: 100 * |intersection| >= threshold * |union| of the sets of distinct ``size``-word shingles. component_id is the
    smallest id that links reach. Nulls, empty texts and
    texts of spaces have an empty set and are linked with nothing. Rows that repeat an id are rows of their own that share
    it; a row without an id has its component's id, or null. A row is kept if its id equals component_id, so exactly one
    id of a component stays. Other columns of ``docs`` are ignored.
    """
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    marked, classes, roots = _grouped(plain, threshold, size)
    firsts = classes.select("key", "first_id").join(roots.withColumnRenamed("node", "key"), "key")
    lowest = firsts.groupBy("root").agg(F.min("first_id").alias("lowest"))
    ids = classes.select("key", "first_id").join(firsts.join(lowest, "root").select("key", "lowest"), "key", "left").select("key", F.coalesce("lowest", "first_id").alias("component_id"))
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = marked.select("doc_id", "n_shingles", "key").join(written(ids), "key", "left")  # a class may hold a third of all rows
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_each(docs: DataFrame, threshold: int = 85, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, rows without an id last, then of the smallest hash of the text.

    Rows without words are components of their own. Rows that repeat an id and a text count once; other columns may differ between
    them, and one of the rows is taken. Texts are shuffled once.
    """
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    marked, _, roots = _grouped(plain, threshold, size)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_key").alias("text"))
    rows = marked.select(place.alias("place"), "key").join(written(roots.withColumnRenamed("node", "key")), "key", "left")
    best = rows.where("key is not null").groupBy(F.coalesce("root", "key").alias("group")).agg(F.min("place").alias("place"))
    every = written(best.select("place").unionByName(rows.where("key is null").select("place")).select(*[F.col(f"place.{c}").alias(f"__{c}") for c in ("none", "id", "text")]).distinct())
    number = F.col(id_col).cast("bigint")
    named = docs.withColumns({"__none": number.isNull(), "__id": F.coalesce(number, F.lit(0)), "__text": F.xxhash64(text_col)})
    keys = ["__none", "__id", "__text"]
    return named.join(every, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
