"""Fuzzy search for short license notices.

A notice of n characters may differ by k = n // 12 edits. Cut into k + 1 parts, at least one part of it is unharmed wherever it
occurs, so an automaton over all parts finds every candidate place in one pass. There the regex library matches the whole
notice with at most k edits and reports the span, in a window that is 2 k characters longer than the notice; windows are
taken from left to right, each from the end of the match before it, so that notices in a row are found one by one and the
cost is bounded by the number of seeds. Of two notices at one place, such as versions of a license, that with fewer edits stays.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import arrow

# Phrases that count exactly, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Notices searched with errors, as words in lower case.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "mozilla public license version 2 0": "mpl-2",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved no part of this publication may be reproduced": "proprietary",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "cc0 1 0 universal public domain dedication": "cc0",
    "eclipse public license version 2 0": "epl-2",
    "boost software license version 1 0": "bsl-1",
    "this software is provided as is without any express or implied warranty": "zlib",
    "licensed under the european union public licence": "eupl",
    "licensed under creative commons attribution 4 0 international": "cc-by",
    "creative commons attribution noderivatives": "cc-by-nd",
}
RATE = 12
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str) -> list[str]:
    """Words of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).decode("utf-8", "surrogatepass").split(" ")


@lru_cache(None)
def _searcher():  # noqa: ANN202
    import ahocorasick
    import regex

    found = ahocorasick.Automaton()
    held: dict[str, list] = {}
    for phrase, label in BASE.items():
        held.setdefault(f" {phrase} ", []).append(("base", label, 0))
    patterns = {}
    for notice in NOTICES:
        k = len(notice) // RATE
        patterns[notice] = (k, regex.compile(f"(?e)(?:{regex.escape(notice)}){{e<={k}}}"))
        cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
        for a, b in zip(cuts, cuts[1:]):
            held.setdefault(notice[a:b], []).append(("seed", notice, a))
    for word, uses in held.items():
        found.add_word(word, (len(word), uses))
    found.make_automaton()
    return found, patterns


def search(text: str) -> tuple[int, list[int], set[str], list[tuple[str, int, int, int, float]]]:
    """Number of words, starts of base phrases, base labels, and the notices found: (label, first word, words, edits, score)."""
    words = [w for w in words_of(text) if w]
    line = f" {' '.join(words)} "
    automaton, patterns = _searcher()
    starts, labels, places = [], set(), {}
    for end, (length, uses) in automaton.iter(line):
        for kind, what, shift in uses:
            at = end + 1 - length
            if kind == "base":
                starts.append(at)
                labels.add(what)
            else:
                places.setdefault(what, []).append(at - shift)
    if not starts and not places:
        return len(words), [], labels, []
    begins = list(accumulate((len(w) + 1 for w in words[:-1]), initial=1))  # where words begin
    spans = []  # (start, stop, edits, notice)
    for notice, spots in places.items():
        k, pattern = patterns[notice]
        done = 0
        for at in sorted(set(spots)):
            if at + len(notice) - k <= done:  # it would end in the match before
                continue
            if (m := pattern.search(line, max(0, done, at - k), max(0, min(at + len(notice) + k, len(line))))) and m.end() > m.start():
                spans.append((m.start(), m.end(), sum(m.fuzzy_counts), notice))
                done = m.end()
    found = []
    spans.sort()
    longest = max((b - a for a, b, *_ in spans), default=0)
    for a, b, edits, notice in spans:
        around = spans[bisect_left(spans, (a - longest,)) : bisect_left(spans, (b,))]
        better = (o for o in around if o[3] != notice and o[2] < edits and 2 * (min(b, o[1]) - max(a, o[0])) > b - a)
        if next(better, None) is None:
            first = bisect_left(begins, a) if line[a] == " " else bisect_right(begins, a) - 1
            found.append((NOTICES[notice], first, len(line[a:b].split()), edits, 1 - edits / len(notice)))
    return len(words), sorted(bisect_left(begins, s) for s in starts), labels, sorted(found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans: one row per row of ``docs``.

    score: the greatest share of unharmed characters of any notice found (1 for a base phrase), or 0. spans: each notice as
    label:first word:words:edits, comma-joined. Nulls and empty texts have no words and no labels; first_word and last_word
    are null then. Ids may be null or repeat; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                rows = [search(t or "") for t in batch.column(1)[i : i + 512].to_pylist()]
                both = [base | {f[0] for f in found} for _, _, base, found in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i : i + 512],
                        pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
                        pa.array([r[1][0] if r[1] else None for r in rows], pa.int64()), pa.array([r[1][-1] if r[1] else None for r in rows], pa.int64()),
                        pa.array([",".join(sorted(r[2])) for r in rows]), pa.array([",".join(sorted(b)) for b in both]),
                        pa.array([max([1.0 if r[2] else 0.0, *(f[4] for f in r[3])]) for r in rows], pa.float64()),
                        pa.array([",".join(f"{a}:{b}:{c}:{d}" for a, b, c, d, _ in r[3]) for r in rows]),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans string"
    return arrow(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), run, schema)
