"""Audit operators on small fixtures with known answers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from bitframe.operators import audit, graphs, lanes, ordered, records, text


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pad_zip_fills_the_shorter_side(spark):
    a = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "k long, a long")
    b = spark.createDataFrame([(1, 5), (3, 7)], "k long, b long")
    assert rows(audit.pad_zip(a, b, "k", ["a"], ["b"], -1)) == [(1, 1, 10, 5), (1, 2, 11, -1), (2, 1, 20, -1), (3, 1, -1, 7)]


def test_pad_zip_leaves_nulls_of_rows(spark):
    a = spark.createDataFrame([(1, None), (1, 11), (None, 5)], "k long, a long")
    b = spark.createDataFrame([(1, 5)], "k long, b long")
    assert rows(audit.pad_zip(a, b, "k", ["a"], ["b"], -1)) == [(1, 1, None, 5), (1, 2, 11, -1), (None, 1, 5, -1)]


@pytest.mark.parametrize("large", [0, 100, 10_000])
def test_numbers_sums_and_carried_values_over_ranges(spark, monkeypatch, large):
    """A key of most rows, null keys, ties and empty tables; all keys, the large one or none over ranges, which are many."""
    monkeypatch.setattr(ordered, "LARGE", large)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    data = [(1 if i % 3 else None if i % 7 == 0 else i % 5, i * 37 % 211, i) for i in range(400)]
    df = spark.createDataFrame(data, "k long, at long, id long")
    by, tens = (["k"], ["at", "id"]), F.when(F.col("id") % 10 == 0, F.col("id"))
    got = {r.id: (r.place, r.total) for r in ordered.numbered(df, *by, total="total").collect()}
    last = {r.id: r.last for r in ordered.carried(df, *by, tens, "last").collect()}
    before = {r.id: r.last for r in ordered.carried(df, *by, tens, "last", own=False).collect()}
    sums = {r.id: (r.s, r.t) for r in ordered.summed(df, *by, {"s": F.col("id"), "t": tens}).collect()}
    then = {r.id: r.then for r in ordered.followed(df, *by, tens, "then").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for key in {k for k, *_ in data}:
        held, total, some = None, 0, None
        mine = sorted((at, i) for k, at, i in data if k == key)
        for place, (_, i) in enumerate(mine, 1):
            assert before[i] == held
            ten = i if i % 10 == 0 else None
            held, total, some = held if ten is None else ten, total + i, some if ten is None else ten + (some or 0)
            following = mine[place][1] if place < len(mine) else 1
            assert got[i] == (place, len(mine)) and last[i] == held and sums[i] == (total, some) and then[i] == (following if following % 10 == 0 else None)
    none = df.where("false")
    assert ordered.numbered(none, *by).count() == ordered.carried(none, *by, F.col("id"), "last").count() == ordered.summed(none, *by, {"s": F.col("id")}).count() == ordered.followed(none, *by, tens, "then").count() == 0
    assert sorted(r.place for r in ordered.numbered(df, [], ["id"]).collect()) == list(range(1, 401))


def test_as_of_ties(spark):
    a = spark.createDataFrame([(1, 5, "x"), (None, 5, "y"), (2, 1, "z")], "k long, at long, v string")
    b = spark.createDataFrame([(1, 5, "p"), (1, 5, "q"), (1, 6, "r"), (None, 4, "n")], "k long, s long, w string")
    assert {r.v: r.last_w for r in records.as_of(a, b, "k", "at", "s", ["w"]).collect()} == {"x": "q", "y": "n", "z": None}


def test_graphs(spark):
    edges = spark.createDataFrame([("g", 0, 1), ("g", 0, 1), ("g", 1, 2), ("g", 2, 1), ("g", 5, 6), ("g", None, 1)], "graph string, src long, dst long")
    roots = spark.createDataFrame([("g", 0)], "graph string, node long")
    assert rows(graphs.reachable(edges, roots, ("graph",))) == [("g", 0, 0), ("g", 1, 1), ("g", 2, 2)]
    dom = graphs.dominators(edges, roots)
    assert {r.node: r.dominators for r in dom.collect()} == {0: [0], 1: [0, 1], 2: [0, 1, 2]}
    assert rows(graphs.loop_headers(edges, dom)) == [("g", 1, 2)]
    assert graphs.reachable(edges.where("false"), roots.where("false"), ("graph",)).count() == 0


def test_classify_blanks_comments_and_takes_hints(spark):
    df = spark.createDataFrame([(1, "cat cat # dog dog dog", None), (2, "cat # dog", "the dog pass"), (3, None, None)], "k long, t string, h string")
    signals = {"cat": [("cat", 3)], "dog": [("dog", 3)]}
    assert rows(text.classify(df, "k", "t", signals, comments="#.*", hint="h").select("k", "family", "score")) == [(1, "cat", 6), (2, "dog", 100), (3, "unknown", 0)]
    assert rows(text.classify(df, "k", "t", signals).select("k", "family")) == [(1, "dog"), (2, "cat"), (3, "unknown")]


def test_lanes(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [4, 3, 2, 1]), (None, [1, 2, 3, 4])], "v array<long>, w array<long>")
    got = df.select(lanes.by_block(F.col("v"), [1, 0]), lanes.by_block(F.col("v"), [-1, 0, 0, -1]), lanes.mask_program("v", "w", ["x < y", "x > y"]), lanes.balanced(F.col("w"), 4, lambda a, x: a - x), lanes.folded(F.col("w"), F.lit(0).cast("bigint"), lambda a, x: a - x)).collect()
    assert tuple(got[0]) == ([2, 1, 4, 3], [1, 1, 1, 4], [True, False, False, True], 0, -10)
    assert tuple(got[1])[:3] == (None, None, None)


def test_diverging_ignores_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, None)], "k long, o string")
    assert rows(audit.diverging(df, "k", "o")) == [(1, 2)]


def test_percent_of_no_rows_is_zero(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "x long")
    assert df.agg(audit.percent(F.col("x") > 1)).first()[0] == 66.7
    assert df.where("false").agg(audit.percent(F.col("x") > 1)).first()[0] == 0.0


def test_delta_leaves_out_what_stays(spark):
    df = spark.createDataFrame([("a", True), ("a", True), ("b", False), ("c", True), ("c", False)], "w string, after boolean")
    assert rows(audit.delta(df, ["w"], "after")) == [("a", 2), ("b", -1)]


def test_first_order_keeps_first_appearance(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (2, "c", 9)], "k long, v string, at long")
    assert rows(audit.first_order(df, "k", "v", "at")) == [(1, ["b", "a"]), (2, ["c"])]


def test_first_true_and_known_place(spark):
    df = spark.createDataFrame([(1, "z"), (4, "y"), (6, "x")], "x long, s string")
    got = df.select("x", audit.first_true(["x % 3 = 0", "x % 2 = 0"]), audit.known_place(F.col("s"), ["x", "y"]))
    assert rows(got) == [(1, -1, 3), (4, 1, 2), (6, 0, 1)]


def test_changed_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None, (1, None)), (1, "a", (2, None))], "x long, s string, then struct<x:long,s:string>")
    assert [r[0] for r in df.select(audit.changed(["x", "s"], "then")).collect()] == ["", "x,s"]


def test_levels_are_longest_paths_and_cycles_are_errors(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 3)], "src long, dst long")
    assert rows(audit.levels(edges, 5)) == [(1, 0), (2, 1), (3, 2), (4, 0)]
    assert rows(audit.levels(edges.where("false"), 5)) == []
    for loop in ([(1, 2), (2, 1)], [(0, 1), (1, 2), (2, 1)]):
        with pytest.raises(ValueError):
            audit.levels(spark.createDataFrame(loop, "src long, dst long"), 5)


@pytest.mark.parametrize("small", [256, 4, 0])
def test_dominators_and_headers_of_small_and_large_graphs(spark, monkeypatch, small):
    """Graphs in rows of their own and graphs by rounds give the same; repeated edges, loops, several roots and nulls."""
    rng = random.Random(28)
    data = [(g, rng.randrange(6), rng.randrange(6)) for g in range(40) for _ in range(rng.randrange(12))] + [(3, None, 1), (None, 0, 1), (50, 1, 2)]
    edges = spark.createDataFrame(data, "graph long, src long, dst long")
    roots = spark.createDataFrame([(g, 0) for g in range(45)] + [(7, 1), (7, 1), (None, 0), (8, None)], "graph long, node long")
    want = graphs.by_rounds(edges, roots)
    monkeypatch.setattr(graphs, "SMALL", small)
    assert rows(graphs.dominators(edges, roots)) == rows(want)
    assert rows(graphs.headers(edges, roots)) == rows(graphs.loop_headers(edges, want)) != []
    assert graphs.dominators(edges.where("false"), roots.where("false")).count() == 0


def test_dominators_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(graphs, "BLOCK", 5)
    edges = spark.range(30).selectExpr("id div 3 as graph", "id % 3 as src", "id % 3 + 1 as dst")
    got = graphs.dominators(edges, edges.selectExpr("graph", "0L as node").distinct()).collect()
    assert sorted((r.graph, r.node, r.dominators) for r in got) == [(g, n, list(range(n + 1))) for g in range(10) for n in range(4)]
