"""Main text, Merkle manifest and periodic runs against plain versions, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import html
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitframe.llm import kernel, maintext, merkle, runs

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# ---- main text

PAGES = {
    "<html><head><title>x</title><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div id=content class='has-sidebar'><h1>Head</h1><p>One <b>two</b>three.</p><div class=ad>Buy now, "
    "a long advert</div><p>Four.<ul><li>five<li>six</ul></div><div class='sidebar'>Side text</div><section id=comments><h3>Comments</h3><div class=comment><p>great article</p></div></section><footer>foot</footer>": "Head One twothree. Four. five six",
    "<div><a href=1>a</a><a href=2>b</a></div><div>Long paragraph of the article with many words.</div><div>Another one &amp; more&nbsp; words.</div><div>Copyright 2020 Foo</div>": "Long paragraph of the article with many words. Another one & more words.",
    "<main><article><h1>T</h1>text a < b and c<br>d<script>x='</p>'</script><p>e<!-- c --> f</article><aside>no</aside></main>": "T text a < b and c d e f",
    "<body><div class='cookie-notice'>We use cookies</div><div class='post-content'>Short.</div><form><p>Name <input></form><div class='share'>Share</div>": "Short.",
    "<article><p>x</p><article class=comment><p>reader</p></article></article>": "x",
    "<div class='ad'><p>left open<article><p>the article</article>": "the article",
    "<div class='page-header'>h</div><div class='main-content'><table><tr><td>a<td>b</table><pre>p \n q</pre></div><div class='comments-area'>c</div>": "a b p q",
    "plain text only": "plain text only",
    "<p>&#233;&eacute;&ampx &nosuch; &#x1F600;": "éé&x &nosuch; 😀",
    "<nav>only a menu</nav>": "",
    "": "",
}


def test_main_text_of_pages(spark):
    rows = [(i, f"u{i}", h) for i, h in enumerate(PAGES)] + [(99, None, None), (None, "u", "<p>no id</p>"), (0, "u0", next(iter(PAGES)))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("mine"), "n_chars": F.lit(-1)})
    got = sorted(map(tuple, maintext.main_text(df).collect()), key=repr)
    want = [(i, u, PAGES.get(h, "no id" if h else ""), len(PAGES.get(h, "no id" if h else ""))) for i, u, h in rows]
    assert got == sorted(want, key=repr)
    assert maintext.main_text(df.limit(0)).collect() == []


def test_main_text_without_marks_lies_between_surge_and_dive():
    menu, text = '<div><a href="/{0}">menu {0}</a></div>', "<div>Paragraph {0} of an article is long enough to be told from what surrounds it.</div>"
    page = "".join(menu.format(i) for i in range(9)) + "<div>Headline</div>" + "".join(text.format(i) for i in range(6)) + "".join(menu.format(i) for i in range(5)) + "<div>short</div>"
    assert maintext.extract(page) == "Headline " + " ".join(re.sub("<[^>]*>", "", text.format(i)) for i in range(6))


@pytest.mark.parametrize("page", ["<p>" * 100000 + "x", "<div>a" * 50000, "<" * 100000 + 'x"', '<a "' * 50000, "<div class='ad'>" * 20000 + "</span>" * 50000, "<title>" * 50000, "<div><a href=x>" * 30000])
def test_main_text_of_odd_pages_takes_linear_time(page):
    assert len(maintext.extract(page)) <= len(page)


def test_main_text_of_made_articles():
    rng = random.Random(3)
    for i in range(60):
        blocks = [" ".join("".join(rng.choice("abcdé&<") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 9))]
        inner = "".join(f"<p>{html.escape(b)}</p>" for b in blocks)
        inner = inner.replace("</p><p>", "</p><div class='ad-slot'>Buy this</div><aside>More</aside><p>", 1)
        page = f"<html><body><div class=menu>m</div><header>h</header><article>{inner}<section class=comments><p>reader</p></section></article><div class='sidebar widget'>s</div><footer>f</footer></body></html>"
        assert maintext.extract(page) == " ".join(" ".join(b.split()) for b in blocks), i


# ---- Merkle manifest

def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def paths(digests):
    """Root and, for each leaf, its siblings with their side (None: no sibling)."""
    at, ways = list(range(len(digests))), [[] for _ in digests]
    while len(digests) > 1:
        for j, p in enumerate(at):
            ways[j].append((p & 1, digests[p ^ 1] if p ^ 1 < len(digests) else None))
        at = [p // 2 for p in at]
        digests = [sha("".join(digests[i : i + 2])) for i in range(0, len(digests), 2)]
    return (digests or [None])[0], ways


def plain_manifest(rows):
    digest = lambda r, more=0: sha("".join(field(v) for v in (r[0], r[1], r[2], r[3] + more if r[3] is not None else None, r[4])))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, digest(r), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: paths([d[2] for d in sorted(groups[x], key=lambda t: t[:3])]) for x in langs}
    root, above = paths([trees[x][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for (_, _, leaf, r), way in zip(sorted(groups[x], key=lambda t: t[:3]), trees[x][1], strict=True):
            h = digest(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf
            for side, sibling in way + above[k]:
                h = sha(h if sibling is None else sibling + h if side else h + sibling)
            out.append((r[0], leaf, trees[x][0], root, sha("".join(s for _, s in way + above[k] if s)), h, h == root))
    return sorted(out, key=repr)


def test_manifest(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 3)  # so that a few hundred rows need several rounds
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", None]), rng.choice(["en"] * 6 + ["de", None, "é", "z"]), rng.choice([None, i]), rng.choice([None, "", "text é 漢", "x" * 5000])) for i in range(-20, 330)]
    rows += [rows[5], rows[5], (7, "other", rows[27][2], 1, "same id"), (None, None, None, None, None), (None, "s", "en", 2**63 - 1, "t"), (2**63 - 1, "s", "one of its kind", 2**63 - 1, "t"), (4, "s", "en", 2**63 - 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"leaf": F.lit("mine"), "i": F.lit(0), "n": F.lit(0), "h": F.lit(0), "place": F.lit(0)})
    assert sorted(map(tuple, merkle.report(df.repartition(5)).collect()), key=repr) == plain_manifest(rows)
    assert sorted(map(tuple, merkle.report(df.limit(0)).collect())) == []
    one = df.where("doc_id = 3")
    assert sorted(map(tuple, merkle.report(one).collect())) == plain_manifest([r for r in rows if r[0] == 3])


# ---- periodic runs

def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(24, 3 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = SPACE.findall(text or "")
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    drop = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-(r[1] * 10**12 // r[2]), r[0], r[2]), default=(None,) * 3)
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if best[2] else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(kept))


def made_words(rng, longest):
    w = []
    for _ in range(rng.randint(1, 5)):
        k, a = rng.choice([1, 2, 3, 5, 8, 9, 12, 16, 17, 31, 33, 40]), rng.choice([1, 2, 2, 3, 50])
        w += ([rng.randrange(a) for _ in range(k)] * 12)[: rng.randint(1, min(longest, k * 8))] + [rng.randrange(a) for _ in range(rng.choice([0, 0, 1, 5, 20]))]
    return w


def test_runs_of_made_sequences():
    rng = random.Random(11)
    for _ in range(400):
        w = made_words(rng, 160)
        ids = np.array(w)
        assert runs.runs_of(ids, kernel.mix(ids.astype(np.uint64) + np.uint64(1))) == plain_runs(w), w


def test_runs_whose_hashes_all_collide():
    rng = random.Random(12)
    for _ in range(60):
        w = made_words(rng, 90)
        assert runs.runs_of(np.array(w), np.zeros(len(w), np.uint64)) == plain_runs(w), w


def test_runs_of_documents(spark):
    rng = random.Random(13)
    texts = [None, "", " \n ", "one", "a " * 23, "a " * 24, "nul\x00 b " * 30, "漢字 é " * 40, "x" * 9000, " ".join(f"w{i}" for i in range(40)) + " " + " ".join(f"v{i % 40}" for i in range(120)) + "\x0b"]
    texts += [" ".join(f"w{x}" for x in made_words(rng, 120)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b " * 20), (5, texts[5]), (-3, texts[9])]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows if t and i is not None)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit("mine"), "runs": F.lit(0)})
    assert sorted(map(tuple, runs.report(df).collect()), key=repr) == sorted((plain_row(*r) for r in rows), key=repr)
    assert runs.report(df.limit(0)).collect() == []
    listed = runs.find(df).where("doc_id = 9").first().runs
    assert [tuple(r) for r in listed] == [(40, 120, 40)]


@pytest.mark.parametrize("words", [[0] * 30000, [i % 7 for i in range(30000)], [i % 9000 for i in range(30000)], list(itertools.islice(itertools.cycle([0, 1, 1]), 30000))])
def test_runs_of_long_documents_are_one(words):
    ids = np.array(words)
    q = {1: 1, 7: 7, 9000: 9000, 2: 3}[len(set(words))]
    assert runs.runs_of(ids, kernel.mix(ids.astype(np.uint64) + np.uint64(1))) == [(0, 30000, q)]


def test_the_pipeline_mixes_shared_texts_by_the_flow(spark):
    from collections import Counter

    import corpus_pipeline
    from bitframe.llm import mixing

    rows = [(i, f"own{i} " * 5, "en", "a", 1) for i in range(40)] + [(100 + i, f"shared{i % 8} " * 6, "en", "bc"[i // 8], 1) for i in range(16)] + [(200 + i, f"c{i} " * 4, "en", "c", 1) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    times = lambda r: (2 * r["taken"] + r["size"]) // (2 * r["size"])
    want, alone = (Counter({r["doc_id"]: times(r) for r in mixing.mix(docs, copies=c).collect() if times(r)}) for c in (True, False))
    assert Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, "").collect()) == want != alone
