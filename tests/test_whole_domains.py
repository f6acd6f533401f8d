"""Rules, guards and contracts are checked on all inputs, however few rows a table has, and on those of its rows."""

import os

import pytest

import __spark_entry__

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables aren't here")


def rows(spark, name):
    return {r[0]: r for r in __spark_entry__.queries()[name](spark, TABLES).collect()}


ALL = {
    "verify_identities": 65536,
    "verify_flags": 65536,
    "verify_guarded": 65536,
    "verify_lift_rules": 65536,
    "verify_multi_instruction": 65536,
    "verify_ub": 65536,
    "verify_interprocedural": 65536,
    "verify_branches": 65536,
    "verify_three_variables": 16777216,
    "memory_words": 73728,
    "memory_paths": 73728,
    "memory_order": 73728,
    "verify_relations": 65536,
}


@pytest.mark.parametrize("name", ALL)
def test_all_inputs_are_checked(spark, name):
    got, lines = rows(spark, name), spark.read.parquet(f"{TABLES}/lineitem.parquet").count()
    assert max(r["rows_checked"] for r in got.values()) == ALL[name]
    assert max(r["rows_met"] for r in got.values()) <= lines and all(r["violations_met"] <= r["rows_met"] for r in got.values())
    assert all(r["status"] != "sampled-agree" for r in got.values())


def test_guards_cover_all_inputs(spark):
    got = rows(spark, "guard_inference")
    assert (got["x<128"]["covered"], got["even"]["covered"], got["x=y"]["covered"]) == (128 * 256, 128 * 256, 256)
    assert all(r["leaks_met"] <= r["rows_met"] for r in got.values())


def test_nodes_of_any_number_of_hops_are_reached(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    spark.range(70).selectExpr("id as l_suppkey", "id + 1 as l_partkey").unionByName(spark.sql("select 70L as l_suppkey, 0L as l_partkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, __spark_entry__.queries()["reachability"](spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(db.sql(__spark_entry__.oracle_sql()["reachability"]).fetchall()) == [(i, i) for i in range(71)]


def test_reconciled_verdicts_are_of_whole_widths(spark):
    got = rows(spark, "verdict_reconcile")
    assert all(r["agree"] for r in got.values())
    assert {r["narrow"] for r in got.values()} == {"refuted", "bounded-proved@4"} and {r["wide"] for r in got.values()} == {"refuted", "bounded-proved@8"}
