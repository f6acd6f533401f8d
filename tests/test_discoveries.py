"""Regions, trees, passages, intervals, automata, reduction and dependencies against plain versions on small fixtures."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from bitframe.operators import automata, dependencies, extensions, intervals, minimise, passages, recurrences, regions, trees
from bitframe.streaming import definitions, versions


def plain_pairs(tokens):
    """Pairs of one text's tokens (place, kind, delta) by a stack for each kind."""
    open_, out = {}, []
    for place, kind, d in sorted(tokens):
        if d == 1:
            open_.setdefault(kind, []).append(place)
        elif d == -1 and open_.get(kind):
            out.append((kind, open_[kind].pop(), place))
    return out


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_balanced_regions_are_those_of_a_stack(spark, block):
    rng = random.Random(block)
    data = [(t, i * 2, rng.choice(["a", "b", None]), rng.choice([1, 1, -1, -1, 0, None])) for t in (1, 2, None) for i in range(150)]
    data += [(3, 0, "a", -1), (3, 1, "a", 1), (4, None, "a", 1)]
    df = spark.createDataFrame(data, "doc long, place long, kind string, delta int").withColumn("note", F.concat(F.lit("n"), "place"))
    got = {tuple(r) for r in regions.matched(df, "doc", "place", ["kind"], "delta", ["note"], block).collect()}
    want = {(t, k, a, b, f"n{b}") for t in (1, 2, 3, 4, None) for k, a, b in plain_pairs([(p, k, d) for u, p, k, d in data if u == t and p is not None])}
    assert got == want
    assert regions.matched(df.where("false"), "doc", "place", ["kind"], "delta").collect() == []
    deep = {(r.doc, r.start): (r.depth, r.parent) for r in regions.nested(regions.matched(df, "doc", "place", ["kind"], "delta"), "doc", block).collect()}
    spans = {(t, a): b for t, _, a, b, _ in want}
    depth = {(t, a): sum(u == t and x <= a < y for (u, x), y in spans.items()) for t, a in spans}
    parent = {(t, a): max((x for (u, x), n in depth.items() if u == t and x < a and n == depth[t, a] - 1), default=None) for t, a in spans}
    assert deep == {k: (depth[k], parent[k]) for k in spans}


def test_a_page_of_a_million_tags(spark):
    n = 250_000
    page = "<div><p>" + "<b>x</b><i>" * n + "</i>" * n + "</p></div>"
    got = regions.elements(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string"), "page_id", "html")
    out = {r["name"]: (r["n"], r["top"]) for r in got.groupBy("name").agg(F.count("*").alias("n"), F.max("depth").alias("top")).collect()}
    assert out == {"div": (1, 1), "p": (1, 2), "b": (n, n + 2), "i": (n, n + 2)}


def test_elements_of_pages(spark):
    html = "<!DOCTYPE html><!-- <b> --><Div a='1'><p>x<p>é🎈</p><br/><script>'</div>'</script><b><i>y</b></i></div></p>"
    got = sorted((r["name"], r["start"], r["stop"], r["depth"], r["parent"]) for r in regions.elements(spark.createDataFrame([(7, html)], "page_id long, html string"), "page_id", "html").collect())
    div, p2, b = html.index("<Div"), html.index("<p>é"), html.index("<b><i>")
    ends = lambda x, at: html.index(x, at) + len(x)
    p1 = html.index("<p>x")
    want = [("b", b, ends("</b>", b), 3, p1), ("div", div, ends("</div></p>", div) - 4, 1, None), ("i", b + 3, ends("</i>", b), 4, b), ("p", p1, len(html), 2, div), ("p", p2, ends("</p>", p2), 3, p1)]
    assert got == sorted(want)


def test_shapes_of_trees_ignore_the_order_of_children(spark):
    rng = random.Random(4)
    rows, kids = [], {}
    for t in range(30):
        for i in range(1, 12):
            p = rng.randrange(0, i) or None
            rows.append((t, i, p, rng.choice(["a", "b", None])))
            kids.setdefault((t, p), []).append(i)
    label, depth = {(t, i): x for t, i, _, x in rows}, {}
    for t, i, p, _ in rows:
        depth[t, i] = depth.get((t, p), 0) + 1
    form = lambda t, i: (str(label[t, i]), tuple(sorted(form(t, k) for k in kids.get((t, i), []))))
    df = spark.createDataFrame([(t, i, p, depth[t, i], x) for t, i, p, x in rows], "tree long, node long, parent long, depth int, label string")
    shaped = trees.canonical(df, "tree", "node", "parent", "depth", "label")
    got = {(r.tree, r.node): (r.shape, r["size"]) for r in shaped.collect()}
    forms = {k: form(*k) for k in got}
    assert len(set(zip([s for s, _ in got.values()], forms.values()))) == len({s for s, _ in got.values()}) == len(set(forms.values()))
    count = lambda f: 1 + sum(map(count, f[1]))
    assert all(n == count(forms[k]) for k, (_, n) in got.items())
    again = {}
    for k, f in forms.items():
        again.setdefault(f, []).append(k)
    want = sorted((str(label[min(v)]), count(f), len(v), len({t for t, _ in v}), *min(v)) for f, v in again.items() if len(v) > 1)
    assert sorted((str(r[0]), *r[1:]) for r in trees.repeated(shaped, "tree", "node", "label").collect()) == want
    assert trees.canonical(df.where("false"), "tree", "node", "parent", "depth", "label").collect() == []


# ---- passages

def test_passages_with_wildcards_are_found_by_their_rarest_words(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(6)] + ["the"] * 4
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80)))) for i in range(40)] + [(90, None), (91, ""), (92, "The, W1; the w1! THE w1"), (None, "the w1 the w1 the")]
    texts += [texts[0], (0, "the same id w1 the w2")]
    patterns = [(i, f"p{i % 3}", [rng.choice([*vocabulary, "*"]) for _ in range(rng.randint(0, 6))]) for i in range(60)] + [(70, "q", ["the", "w1", "the"]), (71, "q", ["the", "w1", "the"]), (72, None, ["nowhere", "at", "all"]), (73, "r", ["the", None]), (None, "n", ["w1", "*", "w1"])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    table = spark.createDataFrame(patterns, "pattern long, kind string, words array<string>")
    got = sorted(map(tuple, passages.search(docs, table, "doc_id", "text").collect()), key=repr)
    want = []
    for d, t in dict.fromkeys(texts):
        w = re.findall(r"[^\x20\x09-\x0D.,;:!?]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        for p, k, x in patterns:
            if x and None not in x and set(x) != {"*"}:
                want += [(p, k, d, i) for i in range(len(w) - len(x) + 1) if all(b in (a, "*") for a, b in zip(w[i:], x))]
    assert got == sorted(want, key=repr) and len(got) > 100
    assert passages.search(docs, table.where("false"), "doc_id", "text").collect() == passages.search(docs.where("false"), table, "doc_id", "text").collect() == []
    cut = passages.cut(docs.where("doc_id = 92"), "doc_id", "text", 2).collect()
    assert [(r.passage, r.words) for r in cut] == [(1, ["the", "w1", "the", "w1"]), (2, ["the", "w1"])]


def test_many_passages_need_no_nested_loop(spark):
    docs = spark.range(300).select("id", F.concat_ws(" ", *[F.concat(F.lit(f"x{k}y"), (F.col("id") * 7 + k) % 50) for k in range(20)]).alias("text"))
    table = spark.range(10_000).select(F.col("id").alias("pattern"), F.array(*[F.concat(F.lit(f"x{k}y"), (F.col("id") + k) % 50) for k in range(3, 9)]).alias("words"))
    found = passages.search(docs, table, "id", "text")
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == 300 * 200  # of every residue there are 200 patterns


# ---- intervals

def test_dyadic_covers_are_exact_and_small(spark):
    rng = random.Random(7)
    data = [(a, a + rng.choice([-1, 0, 1, 5, 77, 1000, 2**40])) for a in (rng.choice([0, -1, rng.randrange(-300, 300), rng.randrange(-(2**50), 2**50)]) for _ in range(200))]
    for r in spark.createDataFrame(data, "lo long, hi long").select("lo", "hi", intervals.cover(F.col("lo"), F.col("hi")).alias("c")).collect():
        spans = sorted((x.node << x.level, (x.node + 1 << x.level) - 1) for x in r.c)
        if r.lo > r.hi:
            assert not spans
            continue
        assert spans[0][0] == r.lo and spans[-1][1] == r.hi and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))
        assert max(sum(x.level == k for x in r.c) for k in range(64)) <= 2


def _stabbed(spark):
    """Points by numbers, which are small before their levels, and ranges of many levels."""
    p = spark.range(300).select(F.col("id").alias("point"), (F.col("id") % 3).alias("k"), (F.col("id") * 1000).alias("at"))
    s = spark.range(40).select((F.col("id") % 3).alias("k"), (F.col("id") * 5000).alias("lo"), (F.col("id") * 5000 + F.shiftleft(F.lit(1).cast("bigint"), 9) * F.col("id")).alias("hi"), F.col("id").alias("span"))
    want = [(q, q % 3, i) for q in range(300) for i in range(40) if i % 3 == q % 3 and i * 5000 <= q * 1000 <= i * 5000 + 512 * i]
    return intervals.enclosing(p, s, ["k"], "at", "lo", "hi"), want


def test_points_with_their_levels_are_not_broadcast(spark):
    pairs, want = _stabbed(spark)
    assert sorted(map(tuple, pairs.select("point", "k", "span").collect())) == want
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()



@pytest.mark.parametrize("grain", [1, 10])
def test_nested_and_overlapping_intervals(spark, grain):
    rng = random.Random(grain)
    points = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(-50, 200)])) for i in range(300)] + [(5, 1, 7)]
    spans = [(j, rng.choice([1, 1, 2, None]), lo, lo + rng.choice([-3, 0, 1, 20, 150])) for j, lo in enumerate(rng.randrange(-60, 190) for _ in range(120))] + [(500, 1, None, 5), (501, 1, 5, None), (3, 1, 0, 9), (3, 1, 0, 9)]
    p, s = spark.createDataFrame(points, "point long, k long, at long"), spark.createDataFrame(spans, "span long, k long, lo long, hi long")
    pairs = intervals.enclosing(p, s, ["k"], "at", "lo", "hi", grain)
    want = [(i, k, t, j, a, b) for i, k, t in points for j, m, a, b in spans if k is not None and k == m and None not in (t, a, b) and a <= t <= b]
    assert sorted(map(tuple, pairs.select("point", "k", "at", "span", "lo", "hi").collect())) == sorted(want)
    best = {}
    for i, _, _, j, a, b in want:
        best.setdefault(i, []).append((b - a, -a, j))
    got = {r.point: (r.n, r.lo, r.hi, r.span) for r in intervals.innermost(pairs, ["point"], "lo", "hi", ["span"]).collect()}
    assert got == {i: (len(v), -min(v)[1], min(v)[0] - min(v)[1], min(v)[2]) for i, v in best.items()}
    assert intervals.enclosing(p, s.where("false"), ["k"], "at", "lo", "hi").collect() == []


def test_stretches_without_gaps(spark):
    rows = spark.createDataFrame([(1, t, i) for i, t in enumerate([5, 1, 2, 9, 9, 30, None])] + [(None, 3, 9)], "k long, at long, id long")
    assert sorted(map(tuple, intervals.gaps(rows, ["k"], "at", ["id"], 4).collect()), key=repr) == [(1, 1, 9, 5), (1, 30, 30, 1), (None, 3, 3, 1)]


# ---- automata

def plain_regions(machine, symbols):
    state, began, out = 0, None, []
    for ref, x in symbols:
        i = machine.symbols.index(x) if x in machine.symbols[:-1] else len(machine.symbols) - 1
        before, (state, anew) = state, machine.step[state][i]
        began = ref if anew or before == 0 else began
        if state == machine.accept:
            out.append((began, ref))
            state = 0
    return out


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_regions_of_an_automaton_over_blocks(spark, bits):
    rng = random.Random(bits)
    machine = automata.sequence(["a", "b", "c"], 2, ["stop"])
    data = [(k, i, rng.choice(["a", "b", "c", "x", None, "stop", "b", "c"])) for k, n in ((1, 400), (2, 30), (None, 60), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(data, "k long, at long, role string")
    got = sorted(map(tuple, automata.regions(df.repartition(3), ["k"], ["at"], "role", "at", machine, bits).collect()), key=repr)
    want = sorted(((k, *r) for k in (1, 2, 3, None) for r in plain_regions(machine, [(i, x) for u, i, x in data if u == k])), key=repr)
    assert got == want and len(want) > 5
    assert automata.regions(df.where("false"), ["k"], ["at"], "role", "at", machine).collect() == []


def test_sequences_mind_gaps_breaks_and_new_beginnings():
    machine = automata.sequence(["a", "b"], 1, ["stop"])
    find = lambda s: plain_regions(machine, list(enumerate(s.split())))
    assert find("a b") == [(0, 1)] and find("a x b") == [(0, 2)] and find("a x x b") == [] and find("a stop b") == [] and find("a a x b a b") == [(1, 3), (4, 5)]


# ---- reduction

MEASURES = lambda: {"bits": ("or", F.col("bits")), "size": ("sum", F.col("size")), "top": ("max", F.col("top"))}


def enough(m, whole):
    return (m("bits") == whole("bits")) & (2 * m("size") >= whole("size")) & (m("top") >= 7)


def test_reduced_inputs_are_minimal(spark):
    rng = random.Random(9)
    data = [(k, i, rng.choice([0, 0, 1, 2, 4, 8, None]), rng.choice([0, 1, 3, None]), rng.choice([0, 6, 7, 9, None])) for k in [*range(25), None] for i in range(rng.choice([1, 3, 20, 60]))]
    df = spark.createDataFrame(data, "k long, i long, bits long, size long, top long").withColumn("v_bits", F.lit("mine"))
    left = minimise.reduced(df, ["k"], "i", MEASURES(), enough)
    got = {}
    for r in left.collect():
        got.setdefault(r.k, set()).add(r.i)

    def holds(rows, whole):
        bits = lambda x: __import__("functools").reduce(lambda a, r: a | (r[2] or 0), x, 0)
        size = lambda x: sum(r[3] or 0 for r in x)
        some = any(r[2] is not None for r in whole) and any(r[3] is not None for r in whole)
        return some and bits(rows) == bits(whole) and 2 * size(rows) >= size(whole) and max((r[4] for r in rows if r[4] is not None), default=-1) >= 7

    for k in {r[0] for r in data}:
        whole = sorted((r for r in data if r[0] == k), key=lambda r: r[1])
        want, upto = [], len(whole)
        if holds(whole, whole):
            while not holds(want, whole):
                upto = next(p for p in range(upto) if holds([*whole[: p + 1], *want], whole))
                want.append(whole[upto])
            assert not any(holds([r for r in want if r is not x], whole) for x in want)
        assert got.get(k, set()) == {r[1] for r in want}, k
    told = minimise.minimal(df, left, ["k"], "i", MEASURES(), enough).collect()
    assert {r.k: r.n_left for r in told} == {k: len(v) for k, v in got.items()} and all(r.holds and r.minimal for r in told)
    spare = left.unionByName(df.where("k = 3").select("k", "i")).distinct()
    assert not all(r.minimal for r in minimise.minimal(df, spare, ["k"], "i", MEASURES(), enough).collect()) or got.get(3) is None or len(got[3]) == sum(r[0] == 3 for r in data)
    assert minimise.reduced(df.where("false"), ["k"], "i", MEASURES(), enough).collect() == []


# ---- dependencies

@pytest.mark.parametrize("seed", [1, 2, 3])
def test_functional_dependencies_are_those_of_all_candidates(spark, seed):
    from itertools import combinations

    rng = random.Random(seed)
    rows = []
    for i in range(60):
        a, b = rng.randrange(4), rng.choice([None, "x", "y"])
        rows.append((i if seed > 1 else rng.randrange(30), a, b, a * 2 % 3, f"{a}{b}", 7, rng.randrange(3)))
    names = ["id", "a", "b", "c", "d", "e", "f"]
    df = spark.createDataFrame([*rows, rows[0]], "id long, a long, b string, c long, d string, e long, f long")
    classes = lambda s: len({tuple(r[names.index(n)] for n in s) for r in rows})
    want = set()
    for k in range(3):
        for x in combinations(sorted(names), k):
            want |= {(x, d) for d in names if d not in x and classes(x) == classes([*x, d]) and not any(e == d and set(y) < set(x) for y, e in want)}
    got = {(tuple(filter(None, r.determinant.split(","))), r.dependent) for r in dependencies.functional(df, names, 2).collect()}
    assert got == want and ((), "e") in want
    assert dependencies.functional(df.where("false"), names).collect() == []


def test_inclusions_between_columns(spark):
    one = lambda *v, kind="long": spark.createDataFrame([(x,) for x in v], f"x {kind}")
    got = {tuple(r) for r in dependencies.inclusions({"a": one(1, 2, None, 1), "b": one(1, 2, 3), "c": one("1", kind="string"), "d": one(None), "e": one(9)}).collect()}
    assert got == {("a", "b"), ("c", "a"), ("c", "b")}


# ---- recurrences

def test_recurrences_are_of_least_degree_and_exact(spark):
    from fractions import Fraction

    forms = {1: lambda i: 5, 2: lambda i: 3 * i - 7, 3: lambda i: i * (i + 1) // 2 + 10**15, 4: lambda i: i * (i - 1) * (i - 2) // 6 - i, 5: lambda i: 2**i, 6: lambda i: i if i != 3 else 9, None: lambda i: 2 * i * i}
    data = [(k, i, f(i)) for k, f in forms.items() for i in range(12)] + [(7, 0, 4), (8, 0, 1), (8, 1, 1), (9, 0, 1), (9, 1, 2), (10, 0, 1), (10, 1, None), (10, 2, 1)]
    df = spark.createDataFrame(data, "k long, i long, y long").withColumn("n", F.lit("mine"))
    got = {r.k: r for r in recurrences.fitted(df, ["k"], ["i"], "y").collect()}
    assert {k: r.degree for k, r in got.items()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: None, 6: None, None: 2, 7: None, 8: 0, 9: None, 10: None}
    for k in (1, 2, 3, 4, None):
        r = got[k]
        assert r.holds and r.n == 12
        assert all(sum(Fraction(int(c), r.multiplier) * i**m for m, c in enumerate(r.coefficients)) == forms[k](i) for i in range(12))
    assert got[5].holds is None and got[10].n == 3
    assert recurrences.fitted(df.where("false"), ["k"], ["i"], "y").collect() == []


# ---- state across runs

def test_versions_count_each_batch_once(spark, tmp_path):
    rows = [(f"f{i % 7}" if i % 5 else None, 100 - i if i % 3 else i) for i in range(60)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, feature string, at long")
    add = versions.adding(str(tmp_path / "state"), "feature", "at", lambda b: b.select("feature", "at"))
    source = lambda: spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = lambda **k: {r.feature: r["at"] for r in versions.state(spark, str(tmp_path / "state"), "feature", "at", "feature string, at long", **k).collect()}
    assert state() == {}
    want = {}
    for run, parts in enumerate(((0, 1), (2,), ())):
        for k in parts:
            frame.where(f"i % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            for f, a in (r for i, r in enumerate(rows) if i % 3 == k):
                want[f] = min(a, want.get(f, a))
        versions.run(source(), add, str(tmp_path / "checkpoint"))
        assert state() == want, run
    before = sorted(map(tuple, spark.read.parquet(str(tmp_path / "state")).collect()), key=repr)
    for k in (1, 0, 2):
        add(frame.where(f"i % 3 = {k}"), k)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "state")).collect()), key=repr) == before and state() == want
    assert state(before=1) == {f: min(a for i, (g, a) in enumerate(rows) if g == f and i % 3 == 0) for i, (f, _) in enumerate(rows) if i % 3 == 0}


# ---- definitions, in batch and on a stream

def plain_definitions(rows, keep):
    out = []
    for u, at, row, symbol, defines in rows:
        if defines or at is None or symbol is None:
            continue
        before = sorted((a, r, s) for v, a, r, s, d in rows if v == u and d and a is not None and s is not None and (a, r) < (at, row))
        pick = lambda name: next(((r, a) for a, r, s in reversed(before) if s == name), None)
        exact, near = pick(symbol), pick(symbol.split(".")[0])
        got = (exact[0], "exact") if exact and at - exact[1] <= keep else (near[0], "base") if near and at - near[1] <= keep else (None, None)
        out.append((None if u is None else str(u), row, *got))
    return sorted(out, key=repr)


def test_definitions_by_name_then_by_base_name(spark, tmp_path):
    rng = random.Random(14)
    minute = 60_000_000
    rows = [(rng.choice([1, 2]), (1000 + rng.randrange(0, 600)) * minute, i, rng.choice(["a", "a.x", "a.y", "b.x", "b"]), rng.random() < 0.4) for i in range(240)]
    odd = [(None, 5, 900, "a", True), (None, 9, 901, "a.z", False), (1, None, 902, "a", False), (1, 7, 903, None, False)]
    kinds = "user long, at long, row long, symbol string, defines boolean"
    keep = 90 * minute
    assert sorted(map(tuple, definitions.last(spark.createDataFrame(rows + odd, kinds), keep).collect()), key=repr) == plain_definitions(rows + odd, keep)
    frame = spark.createDataFrame(rows, kinds).withColumn("time", F.timestamp_micros("at"))
    late = f"(at >= {1200 * minute} and at < {1250 * minute} and row % 2 = 1)"  # within the delay
    for part in (f"at < {1250 * minute} and not {late}", late, f"at >= {1250 * minute}"):
        frame.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(9, 10**6 * minute, 999, "a", False)], kinds).withColumn("time", F.timestamp_micros("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = definitions.use_state_store(spark)
    assert before is None or before.startswith("org.")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    definitions.streamed(stream, keep).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(map(tuple, spark.read.schema(definitions.RESULT).parquet(str(tmp_path / "out")).collect()), key=repr)
    whole = plain_definitions(rows, keep)
    assert got == whole


# ---- operators of users

def test_operators_are_admitted_by_their_results(spark):
    class Halves:
        def eval(self, x: int):
            while x:
                yield (x,)
                x //= 2

    plus = extensions.Scalar("plus", lambda x: x + 1, lambda x: x + 1)
    wrong = extensions.Scalar("wrong at 5", lambda x: F.when(x == 5, 0).otherwise(x + 1), lambda x: x + 1)
    raises = extensions.Scalar("raises", lambda x: x, lambda x: [0, 1][x])
    nulls = extensions.Scalar("nulls", lambda x: F.when(x > 3, x), lambda x: x if x > 3 else None)
    halves = extensions.Table("halves", Halves, lambda x: F.when(x == 0, F.lit([]).cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.log2(x.cast("double")).cast("int")), lambda i: F.call_function("shiftright", x, i))))
    fewer = extensions.Table("fewer", Halves, lambda x: F.array(x))
    registry = extensions.Registry([plus, wrong, raises, nulls, halves, fewer])
    battery = spark.createDataFrame([(x,) for x in (0, 1, 5, 9, 5, None)], "v long")
    got = {r.name: (r.kind, r.checked, r.disagreements, r.witness, r.admitted) for r in registry.verdicts(battery).collect()}
    assert got == {"plus": ("scalar", 4, 0, None, True), "wrong at 5": ("scalar", 4, 1, 5, False), "raises": ("scalar", 4, 2, 5, False), "nulls": ("scalar", 4, 0, None, True), "halves": ("table", 4, 0, None, True), "fewer": ("table", 4, 3, 0, False)}
    with pytest.raises(extensions.Refused):
        registry.apply(battery, "plus", "v", "w")
    assert registry.admit(battery) == {"plus", "nulls", "halves"}
    assert [tuple(r) for r in registry.apply(battery.where("v = 9"), "halves", "v", "w").collect()] == [(9, 9), (9, 4), (9, 2), (9, 1)]
    assert [r.w for r in registry.apply(battery.where("v = 9"), "plus", "v", "w").collect()] == [10]
    with pytest.raises(extensions.Refused):
        registry.apply(battery, "wrong at 5", "v", "w")
    assert registry.admit(battery.where("false")) == set()


def test_the_innermost_of_many_points_needs_no_broadcast(spark):
    pairs, want = _stabbed(spark)
    got = intervals.innermost(pairs, ["point"], "lo", "hi", ["span"])
    best = {}
    for q, _, i in want:
        best.setdefault(q, []).append((512 * i, -5000 * i, i))
    assert {r["point"]: (r["n"], r["span"]) for r in got.collect()} == {q: (len(v), min(v)[2]) for q, v in best.items()}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("large", [10_000, 0])
def test_stretches_of_ordinary_and_of_large_keys(spark, monkeypatch, large):
    from bitframe.operators import ordered

    rng = random.Random(2)
    data = [(k, rng.randrange(400), i) for k, n in ((1, 150), (2, 20), (None, 9), (3, 1)) for i in range(n)]
    want = []
    for k in (1, 2, None, 3):
        at = sorted(t for u, t, _ in data if u == k)
        cuts = [0, *[i for i in range(1, len(at)) if at[i] - at[i - 1] > 4], len(at)]
        want += [(k, at[a], at[b - 1], b - a) for a, b in zip(cuts, cuts[1:])]
    monkeypatch.setattr(ordered, "LARGE", large)  # with 0 keys of more than two tasks' shares are dealt out by ranges
    got = intervals.gaps(spark.createDataFrame(data, "k long, at long, id long").repartition(3), ["k"], "at", ["id"], 4)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_differences_of_ordinary_and_of_large_keys(spark, monkeypatch):
    from bitframe.operators import ordered

    rng = random.Random(25)
    data = [(k, i, v) for k in range(12) for i, v in enumerate([None if k == 11 and i == 2 else rng.randrange(9) if k % 4 == 3 else k + i ** (k % 4) for i in range(rng.randrange(1, 9))])]
    df = spark.createDataFrame(data, "k long, i long, y long")
    found = recurrences.fitted(df, ["k"], ["i"], "y")
    assert "sequence(0, 4" not in found._jdf.queryExecution().toString()  # ordinary keys look ahead, and no row is dealt out
    got = sorted(map(repr, found.collect()))
    monkeypatch.setattr(ordered, "LARGE", 0)
    assert sorted(map(repr, recurrences.fitted(df, ["k"], ["i"], "y").collect())) == got


@pytest.mark.parametrize("part", [7, 20])
def test_functional_dependencies_by_parts(spark, monkeypatch, part):
    """What parts don't refute is decided on all rows: a dependency that one pair of rows violates isn't found."""
    data = [(i, i // 4, i % 5, None if i % 5 == 3 else str(i % 5), float(i // 4)) for i in range(200)] + [(200, 7, 1, "9", 7.0)]
    df = spark.createDataFrame(data, "id long, a long, b long, c string, d double")
    want = sorted(map(tuple, dependencies.functional(df, df.columns).collect()))
    assert ("a", "d") in want and ("c", "b") in want and ("b", "c") not in want and ("id", "c") in want
    monkeypatch.setattr(dependencies, "WHOLE", 50)
    monkeypatch.setattr(dependencies, "PART", part)
    assert sorted(map(tuple, dependencies.functional(df, df.columns).collect())) == want


def test_values_of_inclusions_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(dependencies, "DEALT", 10)
    monkeypatch.setattr(dependencies, "FEW", 5)
    got = dependencies.inclusions({"a": spark.range(100), "b": spark.range(1, 60), "c": spark.range(60).selectExpr("id % 3"), "d": spark.range(0)})
    assert sorted(map(tuple, got.collect())) == [("b", "a"), ("c", "a")]
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().toString() and ", 15)" in got._jdf.queryExecution().toString()


def test_definitions_call_the_state_a_few_times_a_batch():
    """Calls of the state, each of which goes to another process, are counted for a user of many rows."""
    import pandas as pd

    calls = []

    class Values:
        def __init__(self):
            self.held = {}

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                held = self.held
                match name:
                    case "update" | "put":
                        held["v"] = args[0]
                    case "appendList":
                        held["v"] = [*held.get("v", []), *args[0]]
                    case "updateValue":
                        held[args[0]] = args[1]
                    case "get":
                        return held.get("v", [])
                    case "iterator":
                        return iter(list(held.items()))
                    case "exists":
                        return "v" in held
                    case "containsKey":
                        return args[0] in held
                    case "getValue":
                        return held[args[0]]
                    case "removeKey":
                        held.pop(args[0], None)
                    case "clear":
                        held.clear()

            return call

    class Handle:
        getListState = getMapState = getValueState = lambda self, *a: Values()

        def registerTimer(self, at):
            calls.append("registerTimer")

    class At:
        getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: 10**6

    one = definitions.Definitions(10**12)
    one.init(Handle())
    data = [(i * 1000, i, "a" if i % 2 else "a.x", i % 4 == 1) for i in range(400)]
    assert list(one.handleInputRows(("u",), iter([pd.DataFrame(data, columns=["at", "row", "symbol", "defines"])]), At())) == []
    (got,) = one.handleExpiredTimer(("u",), At(), At())
    want = [(u, r, d, f) for u, r, d, f in plain_definitions([("u", *x) for x in data], 10**12)]
    assert sorted(((u, r, None if pd.isna(d) else d, f) for u, r, d, f in got.itertuples(index=False)), key=repr) == want
    assert len(calls) < 20
