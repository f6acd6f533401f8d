"""The training-data operators against plain versions on small fixtures, with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import itertools
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bitframe.llm import chat, fingerprint, kernel, licenses, linededup, minhash, mixing, pii, quality, scratch, sentencepiece, toxicity

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "one", "two words", "é" * 50, "x" * 30000, "a b c d e", "A B C D E", "nul\x00 in 漢字 text", "🎈 smile " * 40, "word " * 3000]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    texts = ODD + [prose(120, i) for i in range(20)]
    near = [prose(300, 99).split() for _ in range(14)]
    for i, words in enumerate(near):
        for j in range(i):
            words[(i * 31 + j * 47) % 300] = f"edit{i}x{j}"
    texts += [" ".join(w) for w in near] + [texts[15]] * 3
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or ""), i % 2) for i, t in enumerate(texts)]
    rows += [rows[14], (None, "no id here at all", "en", "s1", 3, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int").cache()


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def shingles(text):
    w = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def test_near_duplicates(docs):
    rows = rows_of(docs)
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    want = Counter((d, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(rows))
    got = minhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("threshold", [80, 85])
def test_rare_shingles_find_every_pair(spark, threshold):
    """Sets of many sizes over one template, in families, with ties: all pairs of different roots that reach the threshold, and no pair of templates alone."""
    rng = random.Random(threshold)
    template, rows = list(range(100)), []
    for k in range(120):
        own = [1000 * k + 200 + i for i in range(rng.choice([5, 12, 20, 30]))]
        for m in range(rng.choice([1, 1, 3])):
            items = sorted(set(rng.sample(template, rng.choice([100, 100, 97, 60]))) | set(own[m:]))
            rows.append((f"{k:04d}{m}".encode(), rng.choice([b"one", b"two", f"{k}".encode()]), len(items), items))
    rows += [(b"lone", b"lone", 3, [1, 2, 3]), (b"lonf", b"lonf", 3, [1, 2, 3])]
    df = spark.createDataFrame(rows, "key binary, root binary, n_shingles long, items array<long>")
    got = [(bytes(r.a), bytes(r.b)) for r in minhash.rare_pairs(df, threshold).collect()]
    want = set()
    for (a, r, _, x), (b, q, _, y) in itertools.combinations(sorted(rows), 2):
        both = len(set(x) & set(y))
        if r != q and 100 * both >= threshold * (len(x) + len(y) - both):
            want.add((a, b))
    assert len(got) == len(set(got)) and want and want <= set(got) and len(got) < len(rows) * (len(rows) - 1) / 4


def test_pages_of_one_template(spark):
    """Pages that share nine tenths of their words and aren't linked meet nowhere; near copies among them are found."""
    template = prose(900, 1)
    pages = [f"{template} {prose(100, 100 + i)}" for i in range(60)]
    pages += [p.rsplit(" ", 2)[0] for p in pages[:5]]
    docs = spark.createDataFrame(list(enumerate(pages)), "doc_id long, text string")
    words = [p.lower().split() for p in pages]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    low = list(range(len(pages)))
    for i, j in itertools.combinations(range(len(pages)), 2):
        both = len(sets[i] & sets[j])
        if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            low[j] = min(low[i], low[j])
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == dict(enumerate(low)) and len(set(low)) == 60


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(1)
    for j in (0.5, 0.8, 0.95):
        shared = rng.integers(0, 2**63, int(2000 * j), dtype=np.uint64)
        own = [rng.integers(0, 2**63, int(1000 * (1 - j)), dtype=np.uint64) for _ in range(2)]
        a, b = (np.concatenate([shared, o]) for o in own)
        pa_, pb = (minhash.pack(minhash.minima(x))[1] for x in (a, b))
        differ = sum((x := int(p) ^ int(q)) and bin((x | (x >> 1)) & int("01" * 32, 2)).count("1") for p, q in zip(pa_.view(np.uint64), pb.view(np.uint64)))
        estimate = (1 - differ / 160 - 0.25) / 0.75
        assert abs(estimate - len(shared) / (len(shared) + sum(map(len, own)))) < 0.15


def test_pii(docs, spark):
    more = ["a@b.c_d@e.f x@y.z", "1.2.3.4.5.6.7.8 256.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (943) 555-5793 +12", "é 1.2.3.4ß a@b-.co", "9" * 40000, "tel 555-123-4567"]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(extra)
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, m):
        d = [int(c) for c in m if c.isdigit()]
        luhn = sum(c if i % 2 == 0 else 2 * c - 9 * (c > 4) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else False, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]

    want = {}
    for d, t in rows_of(every):
        found = sorted((m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p) in enumerate(patterns.items()) for m in re.finditer(p, t or "") if good(kind, m[0]))
        want[d] = [f[2] for f in found]
    for r in pii.report(every).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(want[r.doc_id]).encode()).hexdigest(), r
        assert set(want[r.doc_id]) <= set(r.spans.split(",")) | {""}


def test_pii_labelers_reliabilities_are_recovered():
    """Votes drawn from known reliabilities: expectation-maximisation finds them, and the share of true spans."""
    rng = random.Random(77)
    truth = [{1: (0.9, 0.05), 0: (0.05, 0.15), -1: (0.05, 0.8)}, {1: (0.7, 0.2), 0: (0.2, 0.2), -1: (0.1, 0.6)}, {1: (0.6, 0.1), 0: (0.3, 0.3), -1: (0.1, 0.6)}, {1: (0.5, 0.2), 0: (0.4, 0.4), -1: (0.1, 0.4)}]
    counts = Counter()
    for _ in range(30_000):
        side = 0 if rng.random() < 0.4 else 1
        counts[tuple(rng.choices((1, 0, -1), [t[c][side] for c in (1, 0, -1)])[0] for t in truth)] += 1
    says, posterior, prior = pii.reliabilities([(n, list(v)) for v, n in counts.items()], 200)
    assert abs(prior - 0.4) < 0.03
    assert all(abs(says[j][c][k] - truth[j][c][k]) < 0.04 for j in range(4) for c in (1, 0, -1) for k in (0, 1))
    assert all(0 <= p <= 1 for p in posterior)


def test_pii_accepts_and_rejects_wide_spans_and_secrets(spark):
    rng = random.Random(6)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f"write to mail alice{i} [at] host{i}.example.com or call phone (202) 555-{1000 + i}") for i in range(60)]
    rows += [(100 + i, f"build release ticket 000-000-0000 section {i}") for i in range(60)]
    rows += [(200 + i, f'the api token = "{hexes(40)}" is set') for i in range(40)]
    rows += [(300 + i, f"see /usr/local/share/long/path{i}/to/some and aaaaaaaaaaaaaaaaaaaa{i % 9} here") for i in range(40)]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame([*rows, (999, None)], "doc_id long, text string")).collect()}
    for i in range(60):
        assert [x.split(":")[0] for x in got[i].spans.split(",")] == ["email", "phone"] and got[i].confidence >= 0.5
        assert got[100 + i].spans == "" and got[100 + i].confidence is None
    for i in range(40):
        at = rows[120 + i][1].index('"') + 1
        assert got[200 + i].secrets == got[200 + i].spans == f"secret:{at}:{at + 40}" and got[200 + i].n_secret == 1
        assert got[300 + i].secrets == ""
    assert got[999].spans == got[999].secrets == "" and got[999].n_secret == 0


def test_quality_counts(docs):
    for r in quality.report(docs).collect():
        t = next(t for d, t in rows_of(docs) if d == r.doc_id) or ""
        w = SPACE.findall(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        repeated = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and not (r.kept and r.base_failed)


def test_toxicity_chain_on_held_out_rows(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        words = prose(60, i).split()
        bad = i % 4 == 0
        for w in rng.sample(["idiot", "moron", "trash", "scum", "stupid"], 3) if bad else ["nice"]:
            words[rng.randrange(60)] = w
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(10_000, None), (10_001, "")], "doc_id long, text string").withColumn("p_toxic", F.lit(9))
    labels = spark.createDataFrame([(r[0], r[2] if r[0] % 29 else 1 - r[2]) for r in rows if r[0] < 400] + [(1, None), (77_777, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    assert all(got[i].toxic == bool(t) and got[i].kept != got[i].toxic for i, _, t in rows if i >= 400)
    assert not got[10_000].toxic and not got[10_001].toxic
    assert {r.toxic for r in toxicity.report(docs, labels.limit(0)).collect()} == {False}


def test_toxicity_of_many_rare_words(spark):
    """Forty words, each in a twentieth of the toxic texts, count; the words of one mislabelled text and its near copies don't."""
    rng = random.Random(11)
    rare = ["".join(rng.choice("klmnop") for _ in range(9)) for _ in range(40)]
    rows = []
    for i in range(1500):
        words = prose(60, 20_000 + i).split()
        for w in rng.sample(rare, 2) if i % 5 == 0 else []:
            words[rng.randrange(60)] = w
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    own = ["".join(rng.choice("qrstuv") for _ in range(9)) for _ in range(60)]
    copies = [(5000 + i, " ".join([*own, f"copy{i}"]), 1) for i in range(12)]
    rows += copies + [(6000, " ".join([*prose(50, 1).split(), *own[::7]]), 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 1000 or 5000 <= r[0] < 6000], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.report(docs, labels).collect()}
    caught = [got[i] for i in range(1000, 1500) if i % 5 == 0]
    assert sum(caught) >= 0.9 * len(caught) and not any(got[i] for i in range(1000, 1500) if i % 5)
    assert not got[6000]
    assert toxicity.family_weights([[1, 2], [2, 3], [4], [3], []]).tolist() == [1 / 3, 1 / 3, 1, 1 / 3, 1]


def test_toxicity_features_are_words_and_their_beginnings():
    texts = ["Idiot, IDIOT! ünter Éclat éclat x", None, "", "abcdefghij abcdeXY", "1 2 3"]

    def plain(text):
        words = re.findall(r"[A-Za-z\u0080-\U0010FFFF]+", text or "")
        words = [re.sub("[A-Z\u00C0-\u00D6\u00D8-\u00DE]", lambda m: m[0].lower(), w) for w in words]
        every = Counter(words) + Counter((k, w[:k]) for w in words for k in toxicity.STEMS if len(w) > k)
        return sorted(every.values())

    import pyarrow as pa

    for block in (texts, texts[::-1]):
        got = [s for _, sets in toxicity.feature_sets(pa.array(block, pa.string())) for s in sets]
        for t, s in zip(block, got):
            counts = plain(t)
            assert len(s) == len(counts) + sum(c > 1 for c in counts) and len(set(s.tolist())) == len(s) and sorted(s.tolist()) == s.tolist()
            some = s[::2]
            assert next(x for _, sets in toxicity.feature_sets(pa.array([t], pa.string()), np.unique(some)) for x in sets).tolist() == some.tolist()


def test_toxicity_chain_is_the_plain_chain():
    """fit_chain and run_chain against plain gradient descent with loops over folds and categories."""
    rng = np.random.Generator(np.random.PCG64(8))
    x = (rng.random((120, 4)) < 0.4).astype(float)
    y = [(x[:, 0] > 0).astype(float), ((x[:, 1] + x[:, 2]) > 1).astype(float), ((x[:, 0] + x[:, 3] + (rng.random(120) < 0.1)) > 0).astype(float)]

    def descend(rows, of, decay=0.01):
        w = [0.0] * (rows.shape[1] + 1)
        for _ in range(6000):
            p = 1 / (1 + np.exp(-(rows @ w[:-1] + w[-1])))
            slope = [*(rows.T @ (p - of) / len(of)), (p - of).mean()]
            w = [a - 1.0 * (b + decay * a) for a, b in zip(w, slope)]
        return np.array(w)

    fold = np.random.Generator(np.random.PCG64(toxicity.SEED)).integers(0, 3, 120)
    seen, want = x, []
    for of in y:
        out = [0.0] * 120
        for k in range(3):
            train = [i for i in range(120) if fold[i] != k]
            w = descend(seen[train], of[train])
            for i in set(range(120)) - set(train):
                out[i] = 1 / (1 + np.exp(-(seen[i] @ w[:-1] + w[-1])))
        want.append(descend(seen, of))
        seen = np.column_stack([seen, out])
    old = toxicity.DECAY
    got = toxicity.fit_chain(x, y, folds=3, decay=0.01)
    assert old == toxicity.DECAY and all(np.abs(a - b).max() < 1e-3 for a, b in zip(got, want))
    p = toxicity.run_chain(want, x)
    first = 1 / (1 + np.exp(-(x @ want[0][:-1] + want[0][-1])))
    second = 1 / (1 + np.exp(-(np.column_stack([x, first]) @ want[1][:-1] + want[1][-1])))
    assert np.allclose(p[:, 0], first) and np.allclose(p[:, 1], second)


def test_toxicity_of_inflected_words_in_any_language(spark):
    """Stems with many endings count as one, in a language of 60 toxic texts among 1,000 others; clean texts that have a stem once stay."""
    rng = random.Random(21)
    stems, rows = ["rézêl", "dökwurz", "bocumel"], []
    for i in range(1200):
        words = [w.replace("a", "é") for w in prose(60, 40_000 + i).split()]
        bad = i % 20 == 0
        for _ in range(4 if bad else 0):
            words[rng.randrange(60)] = rng.choice(stems) + "".join(rng.choice("abcdefgh") for _ in range(3))
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 40 < 30], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.report(docs, labels).collect()}
    assert all(got[i] == bool(t) for i, _, t in rows if i % 40 >= 30)


def test_sentencepiece_is_the_library(docs):
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    own = sentencepiece.Pieces(sentencepiece.MODEL)
    rng = random.Random(5)
    texts = [t for _, t in rows_of(docs) if t and len(t) < 20000] + ["".join(rng.choice("aeh tno\n\t.é漢🎈\\<0xA>_'  ") for _ in range(rng.randint(1, 60))) for _ in range(400)] + ["  two  spaces   three ", "aaaaaaaaaaaaaaaaaaaa", "hhhhhehehehe"]
    for t, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == model.encode(t), t
        assert own.decode(ids) == t.replace(sentencepiece.MARK, " ")
    assert all(r.exact for r in sentencepiece.report(docs).collect())


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_viterbi_is_the_best_of_all_cuts(tmp_path, fallback):
    """Small unigram vocabularies, written by hand: the greatest sum over all cuts, and what the library gives."""
    import sentencepiece as library
    from sentencepiece import sentencepiece_model_pb2 as proto

    rng = random.Random(12)
    mark, spec = sentencepiece.MARK, proto.ModelProto()
    spec.trainer_spec.model_type, spec.trainer_spec.byte_fallback = proto.TrainerSpec.UNIGRAM, fallback
    spec.normalizer_spec.name, spec.normalizer_spec.remove_extra_whitespaces, spec.normalizer_spec.add_dummy_prefix = "identity", False, True
    special = [("<unk>", proto.ModelProto.SentencePiece.UNKNOWN), ("<s>", proto.ModelProto.SentencePiece.CONTROL), ("</s>", proto.ModelProto.SentencePiece.CONTROL)]
    special += [(f"<0x{b:02X}>", proto.ModelProto.SentencePiece.BYTE) for b in range(256)] if fallback else []
    pieces = {mark: -3.0} | {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): -float(rng.randint(1, 40)) / 8 for _ in range(30)}
    pieces |= {mark + p: s - 0.25 for p, s in list(pieces.items())[1:12]}
    for name, kind in special:
        spec.pieces.add(piece=name, score=0.0, type=kind)
    for name, score in pieces.items():
        spec.pieces.add(piece=name, score=score)
    path = str(tmp_path / "small.model")
    (tmp_path / "small.model").write_bytes(spec.SerializeToString())
    own, model = sentencepiece.Pieces(path), library.SentencePieceProcessor(model_file=path)
    lost = min(pieces.values()) - 10

    def best(word):
        if not word:
            return 0.0
        return max(pieces.get(word[:k], lost if k == 1 else -1e9) + best(word[k:]) for k in range(1, min(len(word), 5) + 1))

    texts = ["".join(rng.choice("abcab abcxé") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    for t, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == model.encode(t), t
        words = sentencepiece._WORD.findall(mark + t.replace(" ", mark))
        if all(c in "abc " for c in t) and all(c in pieces for c in "abc"):
            assert abs(sum(pieces[model.id_to_piece(i)] for i in ids.tolist()) - sum(map(best, words))) < 1e-6
        if fallback:
            assert own.decode(ids) == t


def test_ids_of_large_vocabularies_have_four_bytes(docs):
    own = sentencepiece.pieces(sentencepiece.MODEL)
    assert own.width == "<u2"
    text = "x" * 50_000 + "y"  # no spaces: one word
    assert own.decode(own.encode([text])[0]) == text


def test_fingerprints(docs):
    rows = sorted(rows_of(docs), key=lambda r: (r[0] is None, r[0], r[1] or ""))
    got = defaultdict(list)
    for r in fingerprint.report(docs).collect():
        got[r.doc_id].append(r)
    plain = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
    for i, (d, t) in enumerate(rows):
        t, other = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 2
        changed = t[: len(t) - k] + other[:k]
        assert hashlib.sha256(changed.encode()).hexdigest() in {r.edited_sha256 for r in got[d]}
        for r in got[d]:
            assert r.n_chars == len(t) and r.fingerprint == plain[d] and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = next(r for r in got[20])
    assert long.near_edited > 0.3 and long.near_next < 0.1
    a = prose(2000, 1)
    one, two = fingerprint.prints(__import__("pyarrow").array([a, "shifted " + a]))
    assert fingerprint.likeness(one, two) > 0.95


def test_licenses(docs, spark):
    texts = ["Released under the MIT License.", "released undr the MIT licence", "(under the mit license) under the MIT-license", "Apache License, Version 2.0 apache license version 20", "CC BY-NC 4.0", "cc byé nc", "clean words only", "ünder the mit license"]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs.select("doc_id", "text").unionByName(extra)).collect()}
    assert [got[1000 + i].n_base for i in range(8)] == [1, 0, 2, 1, 1, 0, 0, 0]
    assert (got[1002].first_word, got[1002].last_word, got[1000].first_word, got[1004].first_word) == (0, 4, 1, 0)
    assert got[1001].labels == "mit" and 0 < got[1001].score < 1 and got[1006].labels == "" and got[1006].score == 0
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for d, t in rows_of(docs):
        assert got[d].n_words == len(word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))


def test_license_notices_against_plain_edit_distance():
    """All notices with random edits, also one more than allowed, and two in a row: found if and only if some span is near enough."""
    rng = random.Random(31)

    def nearest(notice, line):
        """The least edit distance of the notice to any part of the line, by columns."""
        row = list(range(len(notice) + 1))
        least = row[-1]
        for c in line:
            new = [0]
            for j, d in enumerate(notice, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
            row = new
            least = min(least, row[-1])
        return least

    def harm(text, n):
        out = list(text)
        for _ in range(n):
            i = rng.randrange(len(out))
            out[i : i + 1] = rng.choice([[], [rng.choice("qzx")], [out[i], rng.choice("qzx")]])
        return "".join(out)

    for notice, label in licenses.NOTICES.items():
        k = len(notice) // licenses.RATE
        for n in (0, 1, k, k + 1, k + 3):
            text = f"{prose(6, rng.randrange(10**6))} {harm(notice, n)} {prose(6, rng.randrange(10**6))}"
            line = " " + " ".join(w for w in licenses.words_of(text) if w) + " "
            count, _, _, found = licenses.search(text)
            least = nearest(notice, line)
            mine = [f for f in found if f[0] == label]
            assert bool(mine) == (least <= k) or (least <= k and found and min(f[3] for f in found) < least), (notice, n, found)
            words = line.split()
            assert count == len(words)
            for _, first, size, edits, score in mine:
                part = " ".join(words[first : first + size])
                assert least <= edits <= k and 0 < score <= 1 and min(nearest(x, f" {part} ") for x, y in licenses.NOTICES.items() if y == label) <= edits
    twice = licenses.search("releasd under the mit licence released under the mit license")[3]
    assert [(f[1], f[3]) for f in twice] == [(0, 2), (5, 0)]
    assert [f[0] for f in licenses.search("licensed under the gnu general public license version 3")[3]] == ["gpl-3"]
    import time

    took = []
    for n in (2_000, 8_000):
        began = time.time()
        assert len(licenses.search("released under the mit license " * n)[1]) == n
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 2


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len(SPACE.findall(t or ""))) for d, t in rows_of(docs))
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size
    assert abs(sum(v[0].target for v in by.values()) - sum(r.size for r in got)) < 1e-6
    for rows in by.values():
        assert sum(r.size for r in rows) == rows[0].source_size and abs(sum(r.taken for r in rows) - rows[0].target) <= 1
    again = Counter((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(3)).collect())
    assert again == Counter((r.doc_id, r.taken) for r in got)
    assert mixing.shares({"a": 100, "b": 10, "c": 10}, {"a": 1, "b": 5, "c": 5}, 120) == {"a": 60.0, "b": 30.0, "c": 30.0}
    out = mixing.mixed(docs)
    alone = Counter((r.doc_id, r.source) for r in mixing.mix(docs, copies=False).collect() for _ in range((2 * r.taken + r.size) // (2 * r.size) if r.size else 0))
    assert out.columns == docs.columns and Counter((r.doc_id, r.source) for r in out.collect()) == alone
    assert {r.text for r in out.collect()} <= {r.text for r in docs.collect()}


def test_mixing_flow_is_the_cheapest():
    """The flow against all flows of small networks: as many words, at no greater cost."""
    from itertools import product

    rng = random.Random(4)
    for _ in range(40):
        pools = {}
        for p in range(rng.randint(1, 3)):
            room = {s: rng.randint(1, 3) for s in rng.sample("abc", rng.randint(1, 3))}
            once = rng.randint(1, 2)
            pools[p] = mixing.levels(once, sum(room.values())), room
        quotas = {s: rng.randint(0, 4) for s in "abc"}
        edges = [(p, s, r) for p, (_, room) in pools.items() for s, r in room.items()]

        def price(words, uses):
            total = 0
            for room, cost in uses:
                total, words = total + cost * min(room, words), words - min(room, words)
            return total

        def worth(amounts):
            for s in "abc":
                if sum(n for (_, t, _), n in zip(edges, amounts) if t == s) > quotas[s]:
                    return None
            return -sum(amounts), sum(price(sum(n for (q, _, _), n in zip(edges, amounts) if q == p), pools[p][0]) for p in pools)

        got = mixing.flow(pools, quotas)
        best = min(w for a in product(*[range(r + 1) for _, _, r in edges]) if (w := worth(a)) is not None)
        assert worth([got[p, s] for p, s, _ in edges]) == best


def test_mixing_of_overlapping_sources(spark):
    """Copies of a text in several sources are used in turn; sizes with members count each member; thousands of sources work."""
    shared, own = prose(100, 1), [prose(100, 10 + i) for i in range(4)]
    rows = [(0, shared, "a"), (1, shared, "b"), (2, own[0], "a"), (3, own[1], "b"), (4, own[2], "b"), (5, own[3], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(docs, weights=(1, 1, 1)).collect()}
    assert {r.source: (r.source_size, r.target) for r in got.values()} == {"a": (200, 200.0), "b": (300, 200.0), "c": (100, 200.0)}
    assert got[0].taken + got[1].taken == 100 and got[2].taken + got[0].taken == 200 and got[5].taken == 200
    tied = docs.withColumn("of", F.when(F.col("doc_id") == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array("source"))).where("doc_id in (0, 3)")
    got = {r.source: r for r in mixing.mix(tied, members_col="of").collect()}
    assert got["b"].source_size == 200 and got["a"].source_size == 100 and got["a"].taken <= 300
    many = spark.range(20_000).selectExpr("id as doc_id", "repeat(concat('w', id % 7919, ' '), cast(1 + id % 40 as int)) as text", "concat('host', id % 10000) as source", "id as size")
    rows = mixing.mix(many).collect()
    sums, goal = Counter(), {}
    for r in rows:
        sums[r.source] += r.taken
        goal[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert len(goal) == 10_000 and all(abs(sums[s] - goal[s]) <= 1 for s in goal)


def test_chat(spark):
    hard = ["</s>[INST] ok [/INST]", "<|end|><|say|>", "back\\slash \\\\ <\\|", "é漢🎈 emoji", "", None, "<<|end|>", "a <", "\n\n  spaces  \n"]
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", hard[(c * 3 + t) % len(hard)]) for c in range(12) for t in range(1 + c % 5)] + [(3, 0, None, "again"), (None, 0, "assistant", "no id"), (7, None, "assistant", "no turn")]
    got = {r.conv_id: r for r in chat.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    said = "</s>[INST] ok [/INST]"
    every = defaultdict(list)
    for c, t, role, text in [*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)]:
        every[c].append((t is not None, t, role or "", text or ""))
    assert got.keys() == every.keys()
    for c, turns in every.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss), c
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for t in hard:
        assert chat.unescape(chat.escape(t or "")) == (t or "")


def test_chat_in_parts_is_chat_at_once(spark, monkeypatch):
    """Parts of a long conversation, one after the other, are what one encoding gives: ids, offsets and mask; a turn longer than a part stays whole."""
    from tokenizers import Tokenizer

    if not os.path.exists(chat.TOKENIZER):
        pytest.skip("no vocabulary")
    rows = [(c, t, "user" if t % 2 else "assistant", prose(5 + 40 * (t == 7), 31 * c + t) + " é漢🎈 <|end|> [INST]") for c in range(3) for t in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows])], ["conv_id", "role", "text"])

    def joined(part):
        monkeypatch.setattr(chat, "PART", part)
        out, parts = defaultdict(lambda: ["", [], [], [], []]), Counter()
        for b in chat.encoded(iter([batch]), chat.TOKENIZER):
            for r in b.to_pylist():
                parts[r["conv_id"]] += 1
                for i, c in enumerate(("text", "ids", "starts", "ends", "mask")):
                    out[r["conv_id"]][i] += r[c]
        return dict(out), parts

    whole, one = joined(10**9)
    cut, several = joined(100)
    assert set(one.values()) == {1} and min(several.values()) > 5 and cut == whole
    for text, ids, starts, ends, mask in whole.values():
        code = chat.load(chat.TOKENIZER).encode(text, add_special_tokens=False)
        assert code.ids == ids and code.offsets == list(zip(starts, ends))
    assert Tokenizer.from_file(chat.TOKENIZER).get_vocab_size() > 0
    digests = {}
    for part in (100, 10**9):
        monkeypatch.setattr(chat, "PART", part)
        digests[part] = [b.to_pylist() for b in chat.digested(chat.encoded(iter([batch]), chat.TOKENIZER))]
    assert [r for b in digests[100] for r in b] == [r for b in digests[10**9] for r in b]


def test_fingerprints_of_the_last_id_and_of_none(spark):
    rows = [(2**63 - 1, "the last id"), (None, "no id"), (1, "first"), (2**63 - 1, "the last id again")]
    got = [(r.doc_id, r.n_chars) for r in fingerprint.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted([(d, len(t)) for d, t in rows], key=repr)


def test_line_dedup(docs, spark):
    note = "this long passage of words stands in several documents of the corpus and number 12345 varies"
    texts = [f"{prose(30, 500 + i)}\n{note.replace('12345', str(i * 77))}\n{prose(30, 700 + i)}" for i in range(5)] + ["\n".join(prose(20, 900 + j) for j in range(4))] * 2
    extra = spark.createDataFrame([(2000 + i, t, "keep") for i, t in enumerate(texts)] + [(3000, None, "keep")], "doc_id long, text string, dropped string")
    got = {r.doc_id: r for r in linededup.dedup_lines(extra).collect()}
    assert [got[2000 + i].n_dropped for i in range(7)] == [0, 1, 1, 1, 1, 0, 0]
    assert "passage" in got[2000].text and "passage" not in got[2003].text and got[2003].text.count("\n") == 1
    assert got[3000].text is None and got[2001].dropped == "keep"
    out = linededup.dedup_lines(docs)
    assert out.count() == docs.count()


def test_line_dedup_against_plain_templates(docs, spark):
    """Every setting of the share that may go, on odd, repeated and null-id rows, and the cost of a long text grows with its length."""
    import time

    note = [f"{prose(9, 800 + k)} and {k} more words stand here {prose(4, 900 + k)}" for k in range(4)]
    rng = random.Random(9)
    rows = [(i if i % 7 else None, "\n".join([prose(12, 10_000 + i), *rng.sample(note, i % 4), *(["tiny shared line"] if i % 2 else []), ""][: rng.randint(1, 6)])) for i in range(60)]
    rows += rows[:3] + [(5, rows[8][1]), (70, None), (71, ""), (72, "\n\n")]
    table = spark.createDataFrame(rows, "doc_id long, text string")

    def keys(line):
        w = SPACE.findall(line)
        w = ["<*>" if re.search("[0-9]", x) else x for x in w]
        n, q = len(w), max(0, len(w) - 2) // 4
        blocks = [w[2 : 2 + q], w[2 + q : 2 + 2 * q], w[2 + 2 * q : 2 + 3 * q], w[2 + 3 * q :]]
        whole = [(n, *w[:2], *map(tuple, blocks))]
        return n, [] if n < 3 else whole if n < 10 else whole + [(n, *w[:2], *(("<*>",) if i == j else tuple(b) for i, b in enumerate(blocks))) for j in range(4)]

    key60 = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    seen, first = defaultdict(set), {}
    code = lambda d, t: d if d is not None else 2**62 | key60(t)
    for d, t in [(d, t or "") for d, t in rows]:
        for line in t.split("\n"):
            n, found = keys(line)
            for k in found:
                seen[k].add(key60(t))
                first[k] = min(first.get(k, 2**63), code(d, t))
    often = {k for k, v in seen.items() if (len(v) > 1 if k[0] >= 8 else len({x % 63 for x in v}) >= 8)}
    for most in (50, 100):
        want = Counter()
        for d, t in rows:
            lines = (t or "").split("\n")
            gone = [i for i, line in enumerate(lines) if any(k in often and first[k] != code(d, t or "") for k in keys(line)[1])]
            size = lambda ix: sum(len(SPACE.findall(lines[i])) or 1 for i in ix)
            if 100 * size(gone) > most * size(range(len(lines))):
                gone = []
            want[d, None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t] += 1
        assert Counter((r.doc_id, r.text) for r in linededup.dedup_lines(table, most=most).collect()) == want
    took = []
    for n in (5_000, 20_000):
        text = "\n".join(f"line {i} of a long text with some words {i}" for i in range(n))
        long = spark.createDataFrame([(1, text), (2, text + "\nend")], "doc_id long, text string")
        began = time.time()
        assert [r.n_dropped for r in linededup.dedup_lines(long, most=100).orderBy("doc_id").collect()][1] == n
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] + 10


def test_pipeline_drops_passages_of_what_is_no_copy(spark):
    """A passage that is most of a document goes, unless the document is a near copy; exact and near copies stay whole."""
    import corpus_pipeline

    passage, body = prose(60, 7001), [prose(12, 7100 + i) for i in range(10)]
    edited = [*body[:9], " ".join([*body[9].split()[:-1], "edited"])]
    texts = [prose(40, 7002) + "\n" + passage, prose(40, 7003) + "\n" + passage, "\n".join(body), "\n".join(edited), "\n".join(body), "\n".join(body[:6] + [prose(50, 7004)])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(None, "\n".join(body), "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    assert passage in got[0] and passage not in got[1] and prose(40, 7003) in got[1]
    assert [got[i] for i in (2, 3, 4, None)] == [texts[2], texts[3], texts[4], texts[2]]
    assert got[5] == prose(50, 7004)
    again = spark.createDataFrame([(10, texts[0], "en", "s", 0), (11, texts[1], "en", "s", 0), (12, texts[1], "en", "s", 0)], docs.schema)
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, again, "").collect()}
    assert got[10] == texts[0] and got[11] == got[12] == prose(40, 7003)


def test_kernel_shingles_match_plain_sets(docs):
    texts = [t for _, t in rows_of(docs)]
    plain = [shingles(t) for t in texts]
    import pyarrow as pa

    got = [s for _, data, offsets in kernel.text_blocks(pa.array(texts, pa.string()), 500) for s in kernel.shingle_sets(data, offsets)]
    assert [len(s) for s in got] == [len(s) for s in plain]
    for i in range(0, len(texts), 3):
        for j in range(0, i, 3):
            assert len(np.intersect1d(got[i], got[j])) == len(plain[i] & plain[j])


@pytest.mark.parametrize("run", [pii.report, quality.report, sentencepiece.report, minhash.near_duplicates, fingerprint.report, licenses.scan, mixing.mix, linededup.report], ids=lambda f: f.__module__.split(".")[-1])
def test_empty_tables(docs, run):
    assert run(docs.where("false")).count() == 0


def test_empty_tables_of_labels_and_turns(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.report(docs.where("false"), labels).count() == 0 and mixing.mixed(docs.where("false")).count() == 0 and minhash.one_each(docs.where("false")).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in chat.report(turns).collect()] == [-1]


def test_clashing_names_and_long_texts(spark):
    """Columns that are named as those within the operators keep their values; a text of 150,000 words is a row like others."""
    long = prose(150_000, 3)
    texts = [long, long + " end", prose(40, 4), prose(40, 5), None, "", prose(40, 4)]
    names = ["key", "band", "root", "line", "row", "code", "words", "toxic", "p_toxic", "size", "taken", "bucket", "pattern", "ids", "at", "n", "place"]
    rows = [(i, t, f"s{i % 2}", *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    labels = spark.createDataFrame([(i, int(i == 2)) for i in range(4)], "doc_id long, toxic int")

    def same(df, but=()):
        kept = [n for n in names if n not in but]
        return all(r[n] == f"{n}{r.doc_id}" for r in df.collect() for n in kept) and set(kept) <= set(df.columns)

    one = minhash.one_each(table, 80)
    assert sorted(r.doc_id for r in one.collect()) == [0, 2, 3, 4, 5] and same(one)
    clean = linededup.dedup_lines(table, most=100)
    assert {r.doc_id: r.n_dropped for r in clean.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0} and same(clean)
    scored = toxicity.score(table, labels)
    assert scored.count() == 7 and same(scored, ("toxic", "p_toxic"))
    assert same(mixing.mixed(table)) and same(sentencepiece.encode(table.where("doc_id > 1")), ("ids",))
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(table).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5, 6: 2}


def test_pipeline_stages_keep_what_is_clean(spark, tmp_path):
    import corpus_pipeline

    clean = [(i, prose(80, 5000 + i), "en", f"s{i % 2}", 0) for i in range(30)]
    copies = [(100 + i, clean[0][1], "en", "s0", 0) for i in range(3)]
    spark.createDataFrame(clean + copies + [(200, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, str(tmp_path)).cache()
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        if name in ("toxicity", "line_dedup"):
            assert after.count() == 34
        if name == "near_dedup":
            assert ids == set(range(30)) | {200} and after.count() == 31
        if name != "sentencepiece":
            assert after.columns == corpus_pipeline.COLUMNS
        docs = after
    assert docs.where("n_tokens > 0").count() == docs.count()


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    """Each stage's rows, given what the stage before left: toxic documents, recurring lines, near copies, words of each source and token ids."""
    import corpus_pipeline

    rng, note = random.Random(8), prose(14, 77)
    bad = ["idiot moron pathetic scum worthless trash " + prose(40, 100 + i) + " idiot scum stupid moron" for i in range(30)]
    good = [prose(90, 300 + i) for i in range(60)]
    texts = bad + good
    texts += [prose(60, 600 + i) + "\n" + note + "\n" + prose(30, 700 + i) for i in range(6)]
    near = prose(200, 900).split()
    for i in range(5):
        texts.append(" ".join([*near[: 195 - i], *prose(4, 950 + i).split()]))
    rows = [(i, t, rng.choice(["en", "fr"]), rng.choice(["a", "b", "c"]), len(t)) for i, t in enumerate(texts)] + [(900, good[0], "en", "b", 0), (None, good[1], "en", "c", 0), (901, None, None, None, None), (902, "", "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, int(i < 30)) for i in range(90) if i % 3], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = {name: [tuple(r) for r in df.collect()] for name, df in _staged(spark, str(tmp_path), corpus_pipeline)}
    whole = lambda r: (*r[:4], len(r[1]) if r[1] is not None else None)
    assert Counter(at["toxicity"]) == Counter(whole(r) for r in rows if not (r[0] is not None and r[0] < 30))
    cut = lambda r: r[1].replace(note + "\n", "") if r[1] and note in r[1] and r[0] != 90 else r[1]
    assert Counter(at["line_dedup"]) == Counter(whole((r[0], cut(r), *r[2:])) for r in at["toxicity"])
    root = list(range(len(at["line_dedup"])))
    sets = [shingles(r[1]) for r in at["line_dedup"]]
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    groups = defaultdict(list)
    for i, r in zip(root, at["line_dedup"]):
        groups[i].append(r)
    kept = Counter(at["near_dedup"])
    assert sum(kept.values()) == len(groups) and all(sum(kept[r] for r in set(g)) == 1 for g in groups.values())
    size = lambda r: len(SPACE.findall(r[1] or ""))
    sizes = Counter()
    for r in at["near_dedup"]:
        sizes[r[3]] += size(r)
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    goal = mixing.shares(dict(sizes), {x: (5, 2, 1)[i % 3] for i, x in enumerate(names)}, sum(sizes.values()))
    taken, often = Counter(), Counter(at["mixing"])
    for r in at["mixing"]:
        taken[r[3]] += size(r)
    assert all(r in kept and n <= 3 * kept[r] for r, n in often.items())
    assert all(abs(taken[x] - goal[x]) <= max(size(r) for r in at["near_dedup"]) for x in names)
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    assert Counter(r[:5] for r in at["sentencepiece"]) == often
    for r in at["sentencepiece"]:
        ids = np.frombuffer(r[5], np.uint16).tolist()
        assert ids == model.encode(r[1]) and r[6] == len(ids)
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, r.text, r.n_tokens) for r in run.collect()) == Counter((r[0], r[1], r[6]) for r in at["sentencepiece"])


def _staged(spark, folder, corpus_pipeline):
    from bitframe.llm.scratch import written

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder))
        yield name, docs


def test_components_extend(spark):
    """Components after two lots of edges equal those of all edges at once, also when either lot is empty."""

    def plain(edges):
        root = {}
        for n in {n for e in edges for n in e}:
            root[n] = n
        for _ in root:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    rng = random.Random(5)
    lots = [[(rng.randrange(60), rng.randrange(60, 120)) for _ in range(25)], [(rng.randrange(120), 120 + rng.randrange(20)) for _ in range(25)]]
    for first, second in (lots, lots[::-1], (lots[0], []), ([], lots[1]), ([], [])):
        one, two = (spark.createDataFrame(e, "a bigint, b bigint") for e in (first, second))
        got = {r["node"]: r["root"] for r in minhash.joined(minhash.components(one), two).collect()}
        assert got == plain(first + second)


def test_texts_of_any_number_of_sources_are_in_the_flow(spark):
    """A text of 17 sources, and 400 pairs of sources with a text each: none of them is used up in its sources' own pools."""
    from itertools import combinations

    names = [f"s{i:02}" for i in range(17)]
    rows = [(i, "shared " * 100, s) for i, s in enumerate(names)] + [(100 + i, f"own{i} " * 100, s) for i, s in enumerate(names)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1,)).collect()
    assert sum(r.taken for r in got) == 3400 and sum(r.taken for r in got if r.doc_id < 17) <= 200
    pairs = list(combinations([f"h{i:02}" for i in range(30)], 2))[:400]
    rows = [(2 * i + k, f"p{i} " * 10, s) for i, pair in enumerate(pairs) for k, s in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert len(mixing._overlaps(mixing._measured(docs, 17, "doc_id", "text", "source"), False, True)[1]) == 400


def test_answers_on_neighbours_are_bounded(monkeypatch):
    """What a worker keeps between tasks doesn't grow beyond its bound, and ids don't depend on it."""
    texts = [prose(300, i) for i in range(4)]
    want = [x.tolist() for x in sentencepiece.Pieces(sentencepiece.MODEL).encode(texts)]
    monkeypatch.setattr(sentencepiece, "TOGETHER", 20)
    bounded = sentencepiece.Pieces(sentencepiece.MODEL)
    assert [x.tolist() for x in bounded.encode(texts)] == want and len(bounded.together) <= 21


def test_batches_are_bounded_by_bytes(spark):
    """Workers and executors hold a few MB of texts at once, not as many as 10,000 rows have."""
    texts = spark.range(0, 40, 1, 1).select(F.expr("repeat('abcdefghi ', 100000)").alias("text"))
    run = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"]) for b in batches)
    got = scratch.arrow(texts, run, "n bigint, size bigint").collect()
    assert sum(r["n"] for r in got) == 40 and max(r["size"] for r in got) < 8_000_000


def test_features_of_large_columns_take_little_memory():
    """Temporary arrays are those of a small block, whatever a column holds."""
    import tracemalloc

    column = pa.array([prose(400, i) for i in range(2000)])
    wanted = toxicity.hash_words(["idiot", "house"])
    tracemalloc.start()
    n = sum(len(sets) for _, sets in toxicity.feature_sets(column, wanted))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2000 and peak < 40_000_000


def test_tables_of_the_driver_need_no_python_workers(spark, monkeypatch):
    """Neither fitting nor mixing sends pickled rows, for which executors would start workers of another kind that stay."""
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a: (_ for _ in ()).throw(AssertionError("pickled rows")))
    docs = spark.range(60).selectExpr("id as doc_id", "concat('some words of text ', id, if(id % 3 = 0, ' you idiot', ' fine'))  as text", "if(id % 2 = 0, 'a', 'b') as source")
    labels = spark.range(60).selectExpr("id as doc_id", "if(id % 3 = 0, 1, 0) as toxic")
    assert toxicity.score(docs, labels).count() == 60
    assert mixing.mixed(docs, copies=True).count() > 0
