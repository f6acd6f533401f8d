"""Periodic runs of words in whole texts.

A run of period q is at least 24 words and three periods long. For every power of two B from 8 on, let q be in [B, 2B) (from 1 for
B = 8): a run then holds a block of B words at a multiple of B that stands again q words later within the run. So aligned blocks are
searched for in the whole document, as integer sequences in an Aho-Corasick automaton, and places at a distance of the scale
seed a search to both sides for how far words q apart are identical. Documents in which no eight words stand twice have no run and are left
out by their hashes, and so are blocks whose hash isn't found again at a distance of the scale; what is equal has equal hashes, so this loses
nothing, and automaton and extension compare words, not hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .scratch import arrow

LEAST, PERIODS, BLOCK = 24, 3, 8
KEY = 1024  # words of a block that the automaton holds at most; what they seed is compared in full


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place of a document of ``n`` words whose id asks for a made run; None: its own. Rows without an id stay."""
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a, at = g % n, np.arange(n)
    return np.where(at < a, at, a + (at - a) % (1 + (n - a) // (3 + g % 8)))


def _reach(ids: np.ndarray, at: int, q: int, step: int) -> int:
    """From ``at`` on (down for a ``step`` of -1), how many words equal those ``q`` further, compared in growing slices."""
    found, size = 0, 64
    left = len(ids) - q - at if step > 0 else at + 1
    while left > 0:
        m = min(size, left)
        lo = at if step > 0 else at - m + 1
        differ = ids[lo : lo + m] != ids[lo + q : lo + q + m]
        if differ.any():
            return found + int(np.argmax(differ if step > 0 else differ[::-1]))
        found, left, at, size = found + m, left - m, at + step * m, 2 * size
    return found


def _primitive(ids: np.ndarray, start: int, q: int) -> bool:
    """Whether no smaller period divides ``q`` in the ``q`` words from ``start``; for three periods and more, others can't be."""
    rest, p, word = q, 2, ids[start : start + q]
    while rest > 1:
        p = p if p * p <= rest else rest
        if rest % p == 0:
            d = q // p
            if np.array_equal(word[d:], word[:-d]):
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def _candidates(hashes: np.ndarray, b: int, low: int) -> np.ndarray:
    """Numbers of the aligned blocks whose hash stands again at a distance of ``low`` to 2b - 1 words."""
    blocks = np.arange(0, len(hashes) - low, b)
    hit = np.zeros(len(blocks), bool)
    for d in range(low, 2 * b):
        m = int(np.searchsorted(blocks, len(hashes) - d))
        hit[:m] |= hashes[blocks[:m]] == hashes[blocks[:m] + d]
    return np.flatnonzero(hit)


def _inside(known: set[tuple[int, int, int]], q: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which stretches lie within a known run whose period divides ``q``: what repeats there at ``q`` is that run."""
    runs = sorted((s, s + length) for s, length, period in known if q % period == 0)
    if not runs:
        return np.zeros(len(starts), bool)
    low, high = np.array(runs).T
    at = np.searchsorted(low, starts, "right") - 1
    return (at >= 0) & (np.maximum.accumulate(high)[at] >= ends)


def runs_of(ids: np.ndarray, hashes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs by start, then period, of words as integers; ``hashes``: one for each word."""
    n, b, as_ints = len(ids), BLOCK, None
    found: set[tuple[int, int, int]] = set()
    h = hashes
    for i in range(3):  # hashes of 8 words by doubling
        h = kernel.mix(h[: max(0, len(h) - 2**i)] * kernel._STEP[0] + h[2**i :] * kernel._STEP[1])
    while n >= max(LEAST, PERIODS * b):
        low, size = b if b > BLOCK else 1, min(b, KEY)
        aligned = _candidates(h, b, low)
        if len(aligned):
            as_ints = as_ints or tuple(ids.tolist())
            search = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            places: dict[tuple, list[int]] = {}
            for p in (aligned * b).tolist():
                places.setdefault(as_ints[p : p + size], []).append(p)
            for k, key in enumerate(places):
                search.add_word(key, k)
            search.make_automaton()
            hits = np.fromiter(search.iter(as_ints), np.dtype([("end", np.int64), ("key", np.int64)]))
            hits = hits[np.argsort(hits["key"], kind="stable")]
            cuts = np.searchsorted(hits["key"], np.arange(len(places) + 1))
            done: dict[tuple[int, int], int] = {}
            for k, ps in enumerate(places.values()):
                again = hits["end"][cuts[k] : cuts[k + 1]] - size + 1
                for i in range(0, len(ps), 4096):
                    p = np.array(ps[i : i + 4096])
                    first, last = np.searchsorted(again, p + low), np.searchsorted(again, p + 2 * b)
                    count = last - first
                    o = again[np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())]
                    p = np.repeat(p, count)
                    by = np.lexsort((p, o - p))
                    p, d = p[by], (o - p)[by]
                    edges = np.flatnonzero(np.diff(d, prepend=-1, append=-1))
                    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        q = int(d[lo])
                        for at in p[lo:hi][~_inside(found, q, p[lo:hi], p[lo:hi] + q + size)].tolist():
                            if at < done.get((q, k), 0):
                                continue
                            left = _reach(ids, at - 1, q, -1) if at else 0
                            right = _reach(ids, at, q, 1)
                            start, length, done[q, k] = at - left, left + right + q, at + right
                            if length >= max(LEAST, PERIODS * q) and (start, length, q) not in found and _primitive(ids, start, q):
                                found.add((start, length, q))
        h = kernel.mix(h[: max(0, len(h) - b)] * kernel._STEP[0] + h[b:] * kernel._STEP[1])
        b *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def _row(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """What the report says of one document."""
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = words
    if runs:
        keep = np.ones(len(words), bool)
        for s, length, q in runs:
            keep[s + q : s + length] = False
        kept = [words[i] for i in np.flatnonzero(keep).tolist()]
    s, length, q = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    return len(runs), s, length, q, 1000 * length // q if q else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]


_FIELDS = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", make: bool = False) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent, digests of all runs and of the text without what they repeat, and the runs: one row per row of ``docs``.

    ``make``: documents whose id asks for it get a made run first. Null and empty texts have no words and no runs. Ids may be null
    or repeat; other columns are ignored. A text is worked on whole, in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in kernel.text_blocks(batch.column(1)):
                ids, raw, rows = batch.column(0).slice(row, len(offsets) - 1), data.tobytes(), []
                starts, ends, first = kernel.word_spans(data, offsets)
                hashes = kernel.word_hashes(data, starts, ends)
                orders = [planted(ids[i].as_py(), int(first[i + 1] - first[i])) if make else None for i in range(len(ids))]
                for i, order in enumerate(orders):
                    if order is not None:
                        hashes[first[i] : first[i + 1]] = hashes[first[i] : first[i + 1]][order]
                eights, at = kernel.windows(hashes, first, BLOCK)
                own = np.repeat(np.arange(len(ids)), np.diff(at))
                key = kernel.mix(eights + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                by = np.argsort(key)
                twice = set(own[by[1:][key[by[1:]] == key[by[:-1]]]].tolist())
                for i, order in enumerate(orders):
                    words = raw[offsets[i] : offsets[i + 1]].split()
                    words = words if order is None else [words[j] for j in order.tolist()]
                    if i in twice:
                        number: dict[bytes, int] = {}
                        plain = np.array([number.setdefault(w, len(number)) for w in words])
                        rows.append(_row(words, runs_of(plain, hashes[first[i] : first[i + 1]])))
                    else:
                        rows.append(_row(words, []))
                columns = [ids, *[pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(_FIELDS)[1:], strict=True)]]
                yield pa.RecordBatch.from_arrays(columns, schema=_FIELDS)

    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow(plain, run, "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, runs array<struct<start: bigint, length: bigint, period: bigint>>")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, with made runs; see ``find``."""
    return find(docs, make=True).drop("runs")
