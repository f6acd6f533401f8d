"""SentencePiece encoding and decoding by a forward pass over a trie of words.

Texts are cut into words that begin with the space mark; no piece lies across such a cut. The distinct words of a block are
sorted, which is the order of a depth-first walk of their trie, and the forward pass over a word starts from the states of the
prefix that it shares with the word before.

With a vocabulary of the unigram kind, the state of a prefix is its best score and the piece that ends it: Viterbi. The result of one of
the BPE kind (that at hand is) is the sequence of merges, not the path of the greatest sum of scores, so there
the state of a prefix is the last piece of the prefix's own encoding: a sequence of pieces is the BPE encoding of its
text exactly if each two neighbours, encoded alone, stay as they are, so one piece at most can end at each place, and the walk back
from a word's end gives what the library gives. The kind is read from the model.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import arrow

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "\u2581"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
KEPT = 200_000  # words whose encodings are kept between blocks
TOGETHER = 200_000  # answers on neighbours that are kept: about 300 bytes each, in every worker
BLOCK = 1_000_000


class Pieces:
    """A vocabulary: its pieces, their ids and scores, and the forward pass."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        self.unigram = spec.trainer_spec.model_type == proto.TrainerSpec.UNIGRAM
        if not self.unigram and spec.trainer_spec.model_type != proto.TrainerSpec.BPE:
            raise ValueError("only unigram and BPE models")
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces or not spec.normalizer_spec.add_dummy_prefix:
            raise ValueError("only models that leave texts as they are and put a space before them")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.ids) or (self.unigram and MARK not in self.ids):
            raise ValueError("only models with a piece for the space mark and none with a mark inside")
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown, self.lost = model.unk_id(), min(self.scores.values()) - 10  # score of a character without a piece
        self.longest = max(map(len, self.ids))
        self.together = {}
        self.width = "<u2" if size <= 2**16 else "<u4"
        raw = [b""] * size
        raw[self.unknown] = " \u2047 ".encode()
        for p, i in self.ids.items():
            raw[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            raw[i] = bytes([b])
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.words: dict[str, int] = {}
        self.flat: list[int] = []
        self.firsts = [0]

    def merged(self, text: str) -> list[str]:
        """Plain BPE: of all neighbours that form a piece, the one of the best score, leftmost first, until none is left."""
        parts, after, before = list(text), [*range(1, len(text)), -1], [*range(-1, len(text) - 1)]
        heap = [(-self.scores[text[i : i + 2]], i, i + 1, text[i : i + 2]) for i in range(len(text) - 1) if text[i : i + 2] in self.scores]
        heapq.heapify(heap)
        while heap:
            _, a, b, piece = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != piece:
                continue
            parts[a], parts[b], after[a] = piece, None, after[b]
            if after[b] >= 0:
                before[after[b]] = a
            for x, y in ((before[a], a), (a, after[a])):
                if x >= 0 and y >= 0 and (p := parts[x] + parts[y]) in self.scores:
                    heapq.heappush(heap, (-self.scores[p], x, y, p))
        return [p for p in parts if p is not None]

    def stays(self, a: str, b: str) -> bool:
        """Do two neighbours, or one piece alone if ``a`` is empty, stay as they are?"""
        key = (a, b)
        if (known := self.together.get(key)) is None:
            if len(self.together) > TOGETHER:
                self.together.clear()
            known = self.together[key] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def keep(self, word: str, pieces: Iterable[str]) -> None:
        """Note a word's ids: bytes, or the unknown piece once for each run, for what has no piece."""
        ids, missed = self.ids, False
        for p in pieces:
            if (known := ids.get(p)) is not None:
                self.flat.append(known)
            elif self.bytes:
                self.flat += [self.bytes[b] for b in p.encode("utf-8", "replace")]
            elif not missed:
                self.flat.append(self.unknown)
            missed = known is None
        self.words[word] = len(self.firsts) - 1
        self.firsts.append(len(self.flat))

    def viterbi(self, words: list[str]) -> None:
        """Encode sorted distinct words by the path of the greatest sum of scores; forward scores of common prefixes are used again.

        Of equal sums, the one with the longer last piece is taken, as the library does.
        """
        best: list[float] = [0.0]  # of each prefix of the word before
        back: list[int] = [0]  # where its last piece begins
        old, scores = "", self.scores
        for word in words:
            n = min(len(word), len(old))
            i = next((j for j in range(n) if word[j] != old[j]), n)
            del best[i + 1 :], back[i + 1 :]
            for end in range(i + 1, len(word) + 1):
                top, at = -math.inf, end - 1
                for start in range(max(0, end - self.longest), end):
                    score = scores.get(word[start:end])
                    if score is None:
                        if start < end - 1:
                            continue
                        score = self.lost
                    if best[start] + score > top:
                        top, at = best[start] + score, start
                best.append(top)
                back.append(at)
            old, cuts = word, [len(word)]
            while cuts[-1]:
                cuts.append(back[cuts[-1]])
            cuts.reverse()
            self.keep(word, [word[a:b] for a, b in zip(cuts, cuts[1:])])

    def learn(self, words: list[str]) -> None:
        """Encode sorted distinct words; states of common prefixes are used again."""
        if self.unigram:
            self.viterbi(words)
            return
        last: list[str] = [""]  # the last piece of each prefix of the word before
        old, ids, together = "", self.ids, self.together
        for word in words:
            n = min(len(word), len(old))
            i = next((j for j in range(n) if word[j] != old[j]), n)
            del last[i + 1 :]
            for end in range(i + 1, len(word) + 1):
                for start in range(end - 1, max(-1, end - self.longest - 1), -1):  # at most one piece fits, most often a short one
                    piece = word[start:end]
                    if piece in ids or start == end - 1:
                        left = last[start]
                        if (fits := together.get((left, piece))) is None:
                            fits = self.stays(left, piece)
                        if fits:
                            last.append(piece)
                            break
                else:
                    raise AssertionError(word)
            old, pieces, end = word, [], len(word)
            while end:
                pieces.append(last[end])
                end -= len(last[end])
            self.keep(word, reversed(pieces))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.words) > KEPT:
            self.words, self.flat, self.firsts = {}, [], [0]
        cut = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn(sorted(set(chain.from_iterable(cut)) - self.words.keys()))
        index = np.fromiter(map(self.words.__getitem__, chain.from_iterable(cut)), np.int64)
        flat, firsts = np.array(self.flat, np.int32), np.array(self.firsts, np.int64)
        ids, ends = _gather(flat, firsts[index], firsts[index + 1] - firsts[index])
        at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(c) for c in cut])])]
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes joined, the first space dropped."""
        raw, _ = _gather(self.raw, self.starts[ids], self.sizes[ids])
        text = raw.tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of ``flat``, one after the other, and their ends."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return flat[:0], ends
    return flat[np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)], ends


@lru_cache(1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    a = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > BLOCK:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def encode(docs: DataFrame, model: str = MODEL, text_col: str = "text", out_col: str = "ids", count_col: str | None = None) -> DataFrame:
    """``docs`` with a column of ids, each as two bytes (four, if the vocabulary has more than 65,536), low byte first, and, if named, of their number.

    Null and empty texts have none. The space mark itself, where a text has it, is encoded as a space. Rows may repeat; own columns of
    these names are replaced. A text without spaces is one word.
    """
    added = [out_col, *([count_col] if count_col else [])]
    names = [c for c in docs.columns if c not in added]
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for batch in batches:
            texts = batch.column(place)
            for a, b in _slices(_lengths(texts)):
                found = vocabulary.encode([t or "" for t in texts[a:b].to_pylist()])
                new = [pa.array([x.astype(vocabulary.width).tobytes() for x in found], pa.binary()), pa.array([len(x) for x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*[c[a:b] for c in batch.columns], *new[: len(added)]], [*names, *added])

    plain = docs.select(*names)
    schema = plain.withColumns({c: F.lit(None).cast(t) for c, t in zip(added, ("binary", "bigint"))}).schema
    return arrow(plain, run, schema)


def _lengths(column: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def decode(coded: DataFrame, model: str = MODEL, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``coded`` with the texts of its ids; null ids give an empty text."""
    names = [c for c in coded.columns if c != out_col]
    place = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for batch in batches:
            for a, b in _slices(_lengths(batch.column(place))):
                texts = [vocabulary.decode(np.frombuffer(x or b"", vocabulary.width).astype(np.int64)) for x in batch.column(place)[a:b].to_pylist()]
                yield pa.RecordBatch.from_arrays([*[c[a:b] for c in batch.columns], pa.array(texts, pa.string())], [*names, out_col])

    plain = coded.select(*names)
    return arrow(plain, run, plain.withColumn(out_col, F.lit(None).cast("string")).schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, text_sha256 (of the decoded text), exact: is the decoded text the text itself?"""
    text = F.coalesce("text", F.lit(""))
    both = decode(encode(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")), count_col="n_tokens"))
    return both.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("text_sha256"), (F.col("decoded") == F.replace("text", F.lit(MARK), F.lit(" "))).alias("exact"),
    )
