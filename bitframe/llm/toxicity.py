"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other: insults against persons, contempt, then toxicity as labelled. Each model sees the
features of a text and the probabilities of the categories before it. In training, those come from models that did not
see the row (out-of-fold); afterwards the models are fitted on all rows.

Features are words and beginnings of words of three to seven letters, so that inflected and compound forms count as one,
each of them once for "is there" and once for "is there more than once". No language or script is treated apart.

Labels for the two earlier categories are weak ones: a feature of the category in a text that is labelled toxic. A category has the
words it is given and grows by the features that stand together with them; features of texts without any given word, as of
languages that the given words aren't of, are parted by the main direction in which toxic texts differ.

The chain is fitted on the driver on at most ``SAMPLE`` labelled rows, chosen by a hash of their texts, equal texts once. Only those
of their hashed features that are chosen travel there, and a few keys of their shingles, by which near copies share one vote when
features are chosen. All documents are scored in the executors, whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, minhash
from .scratch import arrow, table, written

SAMPLE, FEATURES, FOLDS, SEED, SUPPORT, DECAY = 8_000, 512, 5, 5, 5, 1e-3
REJECT = 0.3  # a toxic text that stays is worse than a clean one that goes; see the README for both shares
STEMS = (3, 4, 5, 6, 7)  # letters of the beginnings of words that count as features
FAMILY_BANDS = 8  # of four minima each: texts of a similarity of 0.8 share one with a probability of 0.98, of 0.3 with 0.06
# Words that the weak categories begin with, in four languages; fixed values.
CATEGORIES = {
    "insult": ("idiot", "moron", "clown", "loser", "fool", "imbecile", "jerk", "imbécile", "crétin", "abruti", "idiota", "tonto", "payaso", "trottel", "dummkopf", "depp"),
    "contempt": ("stupid", "pathetic", "worthless", "disgusting", "trash", "scum", "garbage", "vermin", "ordure", "minable", "basura", "escoria", "asqueroso", "abschaum", "dreck", "wertlos"),
}
NAMES = (*CATEGORIES, "toxic")
_LETTERS = np.ones(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False  # what parts words
_PLAIN = np.uint64(2**63 - 2)


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capitals from U+00C0 to U+00DE in lower case."""
    out = kernel._LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    after = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[after] += 0x20
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, even 63-bit hash) of all words of letters of a block, then of all beginnings of longer words, length by length."""
    data = lowered(data)
    starts, ends, first = kernel.word_spans(data, offsets, _LETTERS)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    yield owner, (kernel.word_hashes(data, starts, ends) & _PLAIN).astype(np.int64)
    places = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where characters begin
    begin = np.searchsorted(places, starts)
    letters = np.searchsorted(places, ends) - begin
    for k in STEMS:
        longer = letters > k
        at = starts[longer]
        hashes = kernel.word_hashes(data, at, places[begin[longer] + k])
        yield owner[longer], (kernel.mix(hashes + np.uint64(k)) & _PLAIN).astype(np.int64)


def feature_sets(column: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, each text's features, sorted): a hash if it is there, and the hash plus one if it is there more than once.

    With ``wanted`` (sorted features), only those.
    """
    for row, data, offsets in kernel.text_blocks(column):
        owners, keys = [], []
        for of, hashes in tokens(data, offsets):
            if wanted is not None:
                known = np.unique(wanted & ~np.int64(1))
                at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                good = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                of, hashes = of[good], hashes[good]
            owners.append(of)
            keys.append(hashes)
        of, key = np.concatenate(owners), np.concatenate(keys)
        order = np.lexsort((key, of))
        of, key = of[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
        begin = np.flatnonzero(new)
        often = np.diff(np.append(begin, len(key))) > 1
        of, key = np.repeat(of[begin], 1 + often), np.repeat(key[begin], 1 + often)
        key[1:] += (key[1:] == key[:-1]) & (of[1:] == of[:-1])
        if wanted is not None:
            good = np.isin(key, wanted)
            of, key = of[good], key[good]
        cuts = np.searchsorted(of, np.arange(len(offsets)))
        yield row, [key[a:b] for a, b in zip(cuts, cuts[1:])]


def hash_words(words: Sequence[str]) -> np.ndarray:
    """The features of words, whole."""
    found = [np.zeros(0, np.int64)]
    for _, data, offsets in kernel.text_blocks(pa.array(words, pa.string())):
        found.append(next(tokens(data, offsets))[1])
    return np.unique(np.concatenate(found))


def fit_linear(x: np.ndarray, y: np.ndarray, decay: float = DECAY, rounds: int = 50) -> np.ndarray:
    """Logistic regression with a bias (last weight) by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) / len(y) + decay * w
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(y) + decay * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def apply_linear(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_chain(x: np.ndarray, labels: list[np.ndarray], folds: int = FOLDS, seed: int = SEED, decay: float = DECAY) -> list[np.ndarray]:
    """One model per category; each gets the out-of-fold probabilities of those before it as further features."""
    fold = np.random.Generator(np.random.PCG64(seed)).integers(0, folds, len(x))
    models, seen = [], x
    for y in labels:
        out = np.zeros(len(x))
        for k in range(folds):
            train = fold != k
            out[~train] = apply_linear(fit_linear(seen[train], y[train], decay), seen[~train]) if train.any() and (~train).any() else 0.0
        models.append(fit_linear(seen, y, decay))
        seen = np.hstack([seen, out[:, None]])
    return models


def run_chain(models: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probabilities, a column for each category."""
    seen, n = x, x.shape[1]
    for w in models:
        seen = np.hstack([seen, apply_linear(w, seen)[:, None]])
    return seen[:, n:]


def family_weights(keys: list) -> np.ndarray:
    """1 / the size of each text's family: texts that share a key, directly or through others. Texts without keys are alone."""
    root, first = list(range(len(keys))), {}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, of in enumerate(keys):
        for key in of:
            root[find(i)] = find(first.setdefault(key, i))
    tops = np.array([find(i) for i in range(len(keys))], np.int64)
    return 1 / np.bincount(tops, minlength=len(tops))[tops] if len(tops) else np.zeros(0)


def labelled_words(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """toxic, weight, words of the sample; near copies share a weight of one. Rows without a label or with both labels for one text are left out."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("least")).where("toxic = least")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(F.lit(SEED), text_col).alias("at"), F.col(text_col).alias("text"))
    hashed = rows.select("doc_id", "at").join(known, F.col("doc_id") == F.col("l_id"))  # texts don't travel
    rank = hashed.groupBy("at").agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("least"), F.min("doc_id").alias("doc_id")).where("toxic = least")
    picked = written(rank.orderBy("at").limit(sample).select("at", "doc_id", F.col("toxic").cast("int").alias("toxic")))
    chosen = rows.join(F.broadcast(picked), ["at", "doc_id"])  # ``sample`` rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles = [x for _, data, offsets in kernel.text_blocks(batch.column(1)) for x in kernel.shingle_sets(data, offsets)]
            bands = [minhash.pack(minhash.minima(x))[0][:FAMILY_BANDS] if len(x) else [] for x in shingles]
            for row, sets in feature_sets(batch.column(1)):
                here = slice(row, row + len(sets))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[here], batch.column(2)[here], pa.array(sets, pa.list_(pa.int64())), pa.array(bands[here], pa.list_(pa.int64()))], ["at", "toxic", "words", "bands"]
                )

    hashed = arrow(chosen.select("at", "text", "toxic"), run, "at bigint, toxic int, words array<bigint>, bands array<bigint>")
    once = written(hashed.groupBy("at").agg(F.max("toxic").alias("toxic"), F.first("words").alias("words"), F.first("bands").alias("bands")))
    keys = once.select("at", "bands").orderBy("at").collect()  # ``sample`` rows at most
    weights = table(docs.sparkSession, {"at": [r["at"] for r in keys], "weight": family_weights([r["bands"] for r in keys])}, "at bigint, weight double")
    return written(once.join(F.broadcast(weights), "at").select((F.col("toxic") > 0).cast("int").alias("toxic"), "weight", "words"))


def choose(sample: DataFrame, most: int = FEATURES) -> np.ndarray:
    """The features that tell toxic from other texts best: by the deviation of their share of toxic texts from what is usual.

    A feature has to be in ``SUPPORT`` toxic texts, however many toxic texts there are. Near copies count as one text in all, so that
    words of a single mislabelled text and its copies don't count. Only what enough toxic texts have is counted in the others.
    """
    n, toxic = sample.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("toxic"))).first()
    usual = round(toxic / n, 6)
    votes = lambda x: F.round(F.sum(x), 6)  # noqa: E731  (the same in any order of summing)
    words = sample.select("toxic", "weight", F.explode("words").alias("word"))
    bad = words.where("toxic = 1").groupBy("word").agg(votes("weight").alias("toxic")).where(F.col("toxic") >= SUPPORT)
    rest = words.where("toxic = 0").join(written(bad.select("word")), "word", "left_semi").groupBy("word").agg(votes("weight").alias("other"))
    both = bad.join(rest, "word", "left").withColumn("n", F.col("toxic") + F.coalesce("other", F.lit(0.0)))
    z = (F.col("toxic") - F.col("n") * usual) / F.sqrt(F.col("n") * (usual * (1 - usual)))
    got = both.withColumn("z", z).where("z >= 4").orderBy(F.desc("z"), "word").limit(most).select("word").collect()
    return np.sort(np.array([r["word"] for r in got], np.int64))


def matrix(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    """Presence of each feature of the vocabulary."""
    x = np.zeros((len(sets), len(vocabulary)))
    for i, s in enumerate(sets):
        x[i, np.searchsorted(vocabulary, s[np.isin(s, vocabulary, assume_unique=True)])] = 1
    return x


def grown(x: np.ndarray, toxic: np.ndarray, given: list[np.ndarray]) -> list[np.ndarray]:
    """Weak labels of each category, from the given ones (a text has one of its words; rows as in ``x``).

    A feature belongs to the category with whose given words its toxic texts are found most above what is usual. Toxic texts without
    any given word are parted by the sign of the main direction of their features.
    """
    x, out = x[toxic], [g & toxic for g in given]
    known = np.array([g[toxic] for g in out], float)
    bare = ~known.any(0)
    if bare.sum() > 1 and x.shape[1]:
        rest = x[bare] - x[bare].mean(0)
        side = np.linalg.svd(rest, full_matrices=False)[2][0]
        side = side * np.sign(side[np.abs(side).argmax()])  # the sign of a direction is arbitrary
        cast = rest @ side >= 0
        rows = np.flatnonzero(toxic)[bare]
        for c in range(len(out)):
            out[c][rows[cast if c % 2 == 0 else ~cast]] = True
    usual = known.mean(1, keepdims=True)
    lift = (known - usual) @ x  # (category, feature)
    for c in range(len(out)):
        own = (lift[c] > 0) & (lift.argmax(0) == c)
        out[c][np.flatnonzero(toxic)[(x[:, own].sum(1) > x[:, ~own].sum(1)) & ~bare]] = True
    return out


def fit(docs: DataFrame, labels: DataFrame, categories: Mapping[str, Sequence[str]] = CATEGORIES, **columns: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Vocabulary and models. Without labelled rows, a chain that finds nothing toxic."""
    sample = labelled_words(docs, labels, **columns)
    n, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if toxic in (0, n):
        return np.zeros(0, np.int64), [np.array([0.0] * k + [-9.0]) for k in range(len(categories) + 1)]
    vocabulary = choose(sample)
    lexicons = [hash_words(words) for words in categories.values()]
    wanted = F.lit([int(w) for w in np.union1d(vocabulary, np.concatenate(lexicons))]).cast("array<bigint>")
    rows = sample.select("toxic", F.array_intersect("words", wanted).alias("words")).collect()
    rows = sorted((r["toxic"], sorted(r["words"])) for r in rows)  # the same folds on every run
    sets, y = [np.array(w, np.int64) for _, w in rows], np.array([float(t) for t, _ in rows])
    x = matrix(sets, vocabulary)
    given = [np.array([np.isin(words, s).any() for s in sets], bool) for words in lexicons]
    return vocabulary, fit_chain(x, [*[w.astype(float) for w in grown(x, y > 0, given)], y])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT, categories: Mapping[str, Sequence[str]] = CATEGORIES) -> DataFrame:
    """``docs`` with p_<category> for each category, p_toxic (double) and toxic (boolean: p_toxic is ``reject`` or more).

    Null and empty texts have no words and get what the models say to that. Rows without a label are scored like all others; labels without a document
    are not used. Repeated rows get equal results; columns of ``docs`` of the same names are replaced.
    """
    vocabulary, models = fit(docs, labels, categories, id_col=id_col, text_col=text_col)
    kinds = [f"p_{n}" for n in (*categories, "toxic")]
    names = [c for c in docs.columns if c not in (*kinds, "toxic")]
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in feature_sets(batch.column(place), vocabulary):
                p = run_chain(models, matrix(sets, vocabulary))
                yield pa.RecordBatch.from_arrays(
                    [*[c[row : row + len(sets)] for c in batch.columns], *[pa.array(p[:, k]) for k in range(len(kinds))], pa.array(p[:, -1] >= reject)], [*names, *kinds, "toxic"]
                )

    plain = docs.select(*names)
    schema = plain.withColumns({k: F.lit(None).cast("double") for k in kinds}).withColumn("toxic", F.lit(None).cast("boolean")).schema
    return arrow(plain, run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the probabilities, toxic, and kept, its opposite."""
    found = score(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), labels)
    return found.select("doc_id", *(f"p_{n}" for n in NAMES), "toxic", (~F.col("toxic")).alias("kept"))
