"""Verification plans, record operators and sources on small inputs."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitframe.operators import configs, records, search
from bitframe.plans import memory, verify
from bitframe.sources import records as sources
from bitframe.streaming import novelty


def test_catalogue_has_the_known_verdicts(spark):
    d = verify.exhaustive(spark, 8).cache()
    status = lambda rules: {r.rule: r.status for r in verify.verdicts(d, rules, 8).collect()}
    assert set(status(verify.IDENTITIES).values()) == {"bounded-proved@8"}
    assert set(status(verify.NEGATIVES).values()) == {"refuted"}
    assert status(verify.FLAGS) == {
        "drop-nsw": "bounded-proved@8", "add-nsw": "refuted", "drop-nuw": "bounded-proved@8", "nuw-round-trip": "bounded-proved@8", "plain-round-trip": "refuted",
        "drop-exact": "bounded-proved@8", "disjoint-or-add": "bounded-proved@8", "or-add": "refuted", "all-poison": "vacuous",
    }
    assert status(verify.GUARDED)["impossible"] == "vacuous"
    assert set(status(verify.LIFTED).values()) == {"bounded-proved@8"}
    wrong = lambda rules: {n for n, s in status(rules).items() if s == "refuted"}
    assert wrong(verify.STEPS) == {"sub-not-commutative", "factor-wrong-sign"} and wrong(verify.BRANCHES) == {"no-tautology"} and wrong(verify.CALLS) == {"swap-arguments", "drop-used-argument"}
    assert wrong(verify.UNDEFINED) == {"speculate-division", "srem-minus-one-back", "shift-pair", "abs-add-nomin", "cttz-add-nozero"}


def test_memory_contracts_have_the_known_verdicts(spark):
    m = memory.model(spark).cache()
    status = lambda cs: {r.contract: r.status for r in memory.verdicts(m, cs).collect()}
    refuted = {c.name for c in memory.WORDS if c.name.endswith(("fact dropped", "unsound"))}
    assert status(memory.WORDS) == {c.name: "vacuous" if c.name == "impossible-fact" else "refuted" if c.name in refuted else "proved" for c in memory.WORDS}
    assert status(memory.PATHS) == {"dse-across-diamond-allpaths": "proved", "dse-across-diamond-onepath": "refuted", "store-sink-conditional": "proved"}
    assert status(memory.ORDER) == {
        "dse-nonatomic-overwrite": "proved", "dse-atomic-store-not-eliminable": "refuted", "reorder-store-across-sync": "refuted",
        "reorder-nonatomic-nonalias": "proved", "reorder-nonatomic-nonalias: fact dropped": "refuted",
    }


def test_a_mutated_rule_is_refuted_with_the_smallest_witness(spark):
    rules = [verify.Rule(r.name, r.before, ("add", r.after, 1)) for r in verify.IDENTITIES if r.name in ("and-zero", "xor-self", "mul-one")]
    for row in verify.verdicts(verify.exhaustive(spark, 4), [verify.Rule(r.name, r.before, r.after) for r in rules], 4).collect():
        assert row.status == "refuted" and (row.witness_x, row.witness_y) == (0, 0)


def test_guards(spark):
    got = {r.guards: r.works for r in search.guards(verify.exhaustive(spark, 4), "x > y", {"le": "x <= y", "eq": "x = y", "big": "x > 7", "never": "x < 0"}).collect()}
    assert got["le"] and got["eq"] and not got["big"] and not got["never"] and not got["big&never"]


def test_joins_and_windows(spark):
    a = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 5, "c")], "k int, at bigint, v string")
    b = spark.createDataFrame([(1, 5, "x"), (1, 20, "y"), (3, 1, "z")], "k int, s bigint, w string")
    got = {r.v: r.last_w for r in records.as_of(a, b, "k", "at", "s", ["w"]).collect()}
    assert got == {"a": "x", "b": "y", "c": None}
    near = {(r.at, r.s) for r in records.near(a, b, "k", "at", "s", 5).collect()}
    assert near == {(10, 5), (20, 20)}
    assert {r.k: r.v for r in records.last_wins(a, ["k"], ["at"]).collect()} == {1: "b", 2: "c"}
    changes = {r.k: r.change for r in records.baseline(a.where("at <> 20").select("k", "v"), b.select("k", F.col("w").alias("v")).where("v <> 'x'"), "k", ["v"]).collect()}
    assert changes == {1: "changed", 2: "resolved", 3: "new"}


def test_sources(spark, tmp_path):
    schema = T.StructType().add("case", "string").add("n", "long")
    (tmp_path / "a.json").write_text('[{"case": "a", "n": 1}]')
    (tmp_path / "b.json").write_text('{"case": "b", "n": 2}\n\n[1]\n{"case": "c"}\n')
    rows = sources.records(spark, str(tmp_path), schema)
    assert {(r.case, r.n) for r in rows.collect()} == {("a", 1), ("b", 2), ("c", None)}
    sources.write_records(rows.select("n", "case"), str(tmp_path / "out"))
    lines = spark.read.text(str(tmp_path / "out")).collect()
    assert list(json.loads(min(r.value for r in lines))) == ["case", "n"]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "one.cfg").write_text("# first\nkind = 3\nbits=7 # low\nodd=1\nkind=x\n")
    good, bad = sources.configs(spark, str(tmp_path / "c"), ["kind", "bits"])
    assert [(r.kind, r.bits) for r in good.collect()] == [(3, 7)]
    assert {(r.line, r.why) for r in bad.collect()} == {(4, "unknown key"), (5, "not a number")}
    (tmp_path / "c" / "one.cfg").write_text("arith_opcode=0x8\nconst_a = -011\nshape=1=2\nrhs_mode=08\n")
    good, bad = sources.configs(spark, str(tmp_path / "c"), list(configs.FIELDS), normalise=True)
    row = good.first()
    assert (row.arith_opcode, row.const_a, row.const_b, row.int_width) == (2, 0, 1, 2) and {(r.line, r.why) for r in bad.collect()} == {(3, "no single ="), (4, "not a number")}
    assert sources.records(spark, str(tmp_path / "none"), schema, lenient=True).count() == 0
    (tmp_path / "w.json").write_text('[\n{"case": "x",\n "n": 4}\n]')
    assert [(r.case, r.n) for r in sources.records(spark, str(tmp_path / "w.json"), schema).collect()] == [("x", 4)]
    (tmp_path / "cc.json").write_text('[{"file": "a.cpp", "directory": "/d", "command": "c"}, {"command": "x"}]')
    assert [r.file for r in sources.compile_database(spark, str(tmp_path / "cc.json")).collect()] == ["a.cpp"]
    for lot in (["one", None], ["two"]):
        sources.append_events(spark.createDataFrame([(x,) for x in lot], "marker string"), str(tmp_path / "log"))
    assert {r.value for r in spark.read.text(str(tmp_path / "log")).collect()} == {"one", "two"}
    (tmp_path / "d").mkdir()
    full = "".join(f"object {i}: name: '{f}'\nobject {i}: size: {4 if f.startswith('const') else 1}\nobject {i}: hex : 0x{'ffffffff' if f == 'const_a' else '03'}\n" + ("" if f.startswith("const") else f"object {i}: int : {i}\n") for i, f in enumerate(sources.NEEDED))
    (tmp_path / "d" / "full.txt").write_text("num objects: 8\n" + full)
    text = lambda f: r"b'\xfe\xff\xff\xff'" if f == "const_a" else "b'a\\n\\\\'" if f == "shape" else "b'A'"
    (tmp_path / "d2").mkdir()
    (tmp_path / "d2" / "data.txt").write_text("".join(f"object {i}: name: b'{f}'\nobject {i}: size: {4 if f in ('const_a', 'const_b') else 1}\nobject {i}: data: {text(f)}\n" for i, f in enumerate(sources.NEEDED)))
    row = sources.dumps(spark, str(tmp_path / "d2"))[0].first()
    assert (row.const_a, row.const_b, row.rhs_mode, row["shape"]) == (-2, 65 << 24, 65, 92)
    (tmp_path / "d" / "part.txt").write_text("object 0: name: 'shape'\nobject 0: int : 1\n")
    (tmp_path / "d" / "none.txt").write_text("nothing")
    good, bad = sources.dumps(spark, str(tmp_path / "d"))
    row = good.first()
    assert good.count() == 1 and (row.rhs_mode, row.const_a, row.const_b, row.vector_shape) == (1, -1, 3, 0)
    assert {r.file: len(r.missing) for r in bad.collect()} == {"part.txt": 7, "none.txt": 8}
    tree = sources.text_tree(spark, str(tmp_path / "c"), "*.cfg", include=["one"], exclude=["two"])
    assert tree.count() == 1


def test_windows_on_a_stream(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00"), ("a", "2024-01-01 01:00:00"), ("z", "2024-01-02 00:00:00"), ("z", "2024-01-03 00:00:00")]
    frame = spark.createDataFrame(rows, "k string, t string").selectExpr("k", "cast(t as timestamp) as t")
    for part, low in enumerate(("2024-01-01", "2024-01-02", "2024-01-03")):
        frame.where(f"cast(t as date) = '{low}'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k string, t timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, made in (("counts", novelty.counted(stream(), "k", "t")), ("visits", novelty.sessions(stream(), "k", "t"))):
        q = made.writeStream.format("memory").outputMode("append").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert {(r.k, r.n) for r in spark.table("counts").collect()} >= {("a", 2), ("b", 1), ("a", 1)}
    assert {(r.k, r.n) for r in spark.table("visits").collect()} >= {("a", 2), ("b", 1), ("a", 1)}


def test_stream_keeps_first_rows(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00")], "k string, t string").selectExpr("k", "cast(t as timestamp) as t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "in"))
    q = novelty.first_seen(stream, "k", "t").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.k for r in spark.table("firsts").collect()} == {"a", "b"} and spark.table("firsts").count() == 2


def test_files_of_one_folder_may_differ(spark, tmp_path):
    """Lines, an array over many lines, arrays on one line, blanks, wrong types and broken texts, in any order of files."""
    schema = T.StructType().add("case", "string").add("n", "long")
    folder = tmp_path / "mixed [1]"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.json").write_text('{"case": "a", "n": 1}\n\n{"case": "b", "n": "x"}\n{"case": \nnothing\n[{"case": "c", "n": 3}, 5, {"n": 4}]\n')
    (folder / "b c.json").write_text('\n\n [\n {"case": "d",\n "n": 5},\n {"case": "e", "n": 6}\n]\n')
    (folder / "z.json").write_text("[\n{broken\n")
    (folder / "deep" / "f.json").write_text('[\n{"case": "f", "n": 7}, {"case": "g", "n": []}]')
    (folder / "deep" / "empty.json").write_text("")
    rows, rejects = sources.ragged(spark, str(folder).replace("[", "\\[").replace("]", "\\]"), schema, recursive=True)
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([("a", 1), ("c", 3), (None, 4), ("d", 5), ("e", 6), ("f", 7)], key=str)
    got = sorted((r.file.rsplit("/", 1)[1], r.why) for r in rejects.collect())
    assert got == sorted([("a.json", "not JSON of this schema")] * 2 + [("a.json", "not an object")] * 2 + [("f.json", "not JSON of this schema"), ("z.json", "not JSON of this schema")])
    assert sources.ragged(spark, str(tmp_path / "none"), schema, lenient=True)[1].count() == 0
