"""64-bit words of keys whose products pass 63 bits."""

import random

import pytest

import __spark_entry__

KEYS = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint"
TOP = 2**64


def signed(x):
    x %= TOP
    return x - TOP if x >= TOP // 2 else x


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """Lines with the keys of tables many times as long, and their words a and b as plain integers."""
    rng = random.Random(64)
    rows = [(rng.randrange(2**k), rng.randrange(1, 8), rng.randrange(2**k), rng.randrange(2**k)) for k in (10, 20, 24, 28, 40, 62) for _ in range(40)]
    folder = str(tmp_path_factory.mktemp("large"))
    spark.createDataFrame(rows, KEYS).write.parquet(f"{folder}/lineitem.parquet")
    return folder, {r: (signed(r[0] * 1000003 * (r[2] * 8191 + 1) - 4611686018427387), signed(r[3] * 16777259 * (-1 if r[1] % 2 == 0 else 1) * (r[2] % 1000))) for r in rows}


def test_products_of_large_keys_wrap(spark, large):
    folder, words = large
    got = __spark_entry__.queries()["bv_mul64_limbs"](spark, folder).collect()
    assert {tuple(r)[:4]: r["v"] for r in got} == {k: signed(a * b) for k, (a, b) in words.items()}


def test_words_of_large_keys(spark, large):
    folder, words = large
    for r in __spark_entry__.queries()["bv_word64"](spark, folder).collect():
        a, b = words[tuple(r[c] for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))]
        n, ua, ub = 11 * r["l_linenumber"], a % TOP, b % TOP
        want = {"added": signed(a + b), "subtracted": signed(a - b), "ult": ua < ub, "slt": a < b, "shl": signed(ua << n) if n < 64 else 0, "lshr": signed(ua >> n) if n < 64 else 0, "udiv": signed(ua // ub) if ub else -1}
        assert {k: r[k] for k in want} == want
