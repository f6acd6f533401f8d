"""Queries against their SQL in DuckDB, on the smallest tables; without the tables there is nothing to compare."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
TABLES = "/root/testdata/sf0.001"
SOME = [
    "verify_identities", "verify_ub", "verify_poison_states", "verify_freeze", "verify_mutants", "undef_risk", "memory_words", "memory_order", "memory_bytes_of_words", "contract_tables", "vec_arith", "vec_folds", "scalable_shuffle", "scalable_mask_program",
    "vec_lane_poison", "fp_semantics", "fp_reduce", "bv_mul64_limbs", "category", "marker_patches", "emitted_vs_recomputed", "attribution_join", "guard_text_facts", "rule_table_match", "match_set_join", "candidate_promotion", "triage", "program_graph",
    "path_check", "graph_contract", "houdini", "output_pairing", "bounded_unroll", "constraint_configs", "asof_enclosing", "pad_zip", "limit_omitted",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables aren't here")


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        db.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    yield db
    db.close()


def test_every_query_has_its_sql():
    import __spark_entry__

    assert set(SOME) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", SOME)
def test_rows_are_those_of_the_sql(spark, duck, name):
    import __spark_entry__

    df = __spark_entry__.queries()[name](spark, TABLES)
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    names = sorted(df.columns)
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect()) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["innermost_session", "enclosing_sessions"])
def test_sessions_around_events_send_no_table_through_the_driver(spark, name):
    import __spark_entry__

    context, store = spark.sparkContext._jsc.sc(), spark._jsparkSession.sharedState().statusStore()
    context.listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    before = max((runs.apply(i).executionId() for i in range(runs.size())), default=-1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")  # Spark broadcasts whatever it may
    try:
        __spark_entry__.queries()[name](spark, TABLES).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    context.listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size()) if runs.apply(i).executionId() > before]
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p]


DOCUMENTS = [(0, None), (1, ""), (2, "\n\n"), (3, "a"), (4, "\n\na\n"), (5, "7\n\n7"), (6, "x" * 150 + "\n1\n" + "y" * 150 + "\n" + "z" * 90), (7, "\n".join(["no", "é🎈 4", "", "4 5", "\r", "5"]))]


def of_documents(spark, folder, name, rows):
    """Rows of a query and of its SQL over ``documents`` made of (doc_id, text)."""
    import __spark_entry__

    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    df = __spark_entry__.queries()[name](spark, str(folder))
    with duckdb.connect() as db:
        db.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
        want = db.sql(__spark_entry__.oracle_sql()[name])
        assert df.columns == want.columns
        return sorted(map(tuple, df.collect()), key=repr), sorted(want.fetchall(), key=repr)


def test_documents_without_text_need_none_of_their_lines(spark, tmp_path):
    got, want = of_documents(spark, tmp_path, "least_lines", DOCUMENTS)
    assert got == want and {d for d, _ in got} == {3, 4, 5, 6, 7}


def test_checked_lines_are_those_of_documents_with_text_and_id(spark, tmp_path):
    got, want = of_documents(spark, tmp_path, "least_lines_checked", [*DOCUMENTS, (None, "a1\nb2\n\nxx")])
    assert got == want and {d for d, *_ in got} == {3, 4, 5, 6, 7}
