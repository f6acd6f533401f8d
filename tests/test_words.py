"""Machine-integer semantics against plain Python, exhaustively at four bits."""

import pytest
from pyspark.sql import functions as F

from bitframe.functions.words import COMPARE, Unsupported, Words
from bitframe.plans.expression import compiled, variables

W = 4
M, H = 2**W - 1, 2 ** (W - 1)


def signed(a):
    return a - 2**W if a >= H else a


def trunc_div(a, b):
    q = abs(a) // abs(b)
    return -q if (a < 0) != (b < 0) else q


PLAIN = {
    "add": lambda a, b: (a + b) & M, "sub": lambda a, b: (a - b) & M, "mul": lambda a, b: (a * b) & M, "and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a ^ b,
    "shl": lambda a, b: (a << b) & M if b < W else 0, "lshr": lambda a, b: a >> b if b < W else 0, "ashr": lambda a, b: (signed(a) >> min(b, W - 1)) & M,
    "udiv": lambda a, b: a // b if b else M, "urem": lambda a, b: a % b if b else a,
    "sdiv": lambda a, b: trunc_div(signed(a), signed(b)) & M if b else (M if signed(a) >= 0 else 1), "srem": lambda a, b: (signed(a) - signed(b) * trunc_div(signed(a), signed(b))) & M if b else a,
    "umin": min, "umax": max, "smin": lambda a, b: min(signed(a), signed(b)) & M, "smax": lambda a, b: max(signed(a), signed(b)) & M,
    "uadd_sat": lambda a, b: min(a + b, M), "usub_sat": lambda a, b: max(a - b, 0), "sadd_sat": lambda a, b: max(-H, min(H - 1, signed(a) + signed(b))) & M, "ssub_sat": lambda a, b: max(-H, min(H - 1, signed(a) - signed(b))) & M,
    "ult": lambda a, b: int(a < b), "sle": lambda a, b: int(signed(a) <= signed(b)), "eq": lambda a, b: int(a == b),
}
UNARY = {"neg": lambda a: -a & M, "not": lambda a: ~a & M, "abs": lambda a: abs(signed(a)) & M, "ctpop": lambda a: a.bit_count(), "ctlz": lambda a: W - a.bit_length(), "cttz": lambda a: (a & -a).bit_length() - 1 if a else W, "bitreverse": lambda a: int(f"{a:04b}"[::-1], 2)}
FLAGS = {
    ("add", "nsw"): lambda a, b: not -H <= signed(a) + signed(b) < H, ("add", "nuw"): lambda a, b: a + b > M, ("sub", "nsw"): lambda a, b: not -H <= signed(a) - signed(b) < H, ("sub", "nuw"): lambda a, b: a < b,
    ("mul", "nsw"): lambda a, b: not -H <= signed(a) * signed(b) < H, ("mul", "nuw"): lambda a, b: a * b > M, ("shl", "nuw"): lambda a, b: b >= W or a << b > M, ("shl", "nsw"): lambda a, b: b >= W or not -H <= signed(a) << b < H,
    ("lshr", "exact"): lambda a, b: PLAIN["shl"](PLAIN["lshr"](a, b), b) != a, ("udiv", "exact"): lambda a, b: b != 0 and a % b != 0, ("or", "disjoint"): lambda a, b: a & b != 0,
}


@pytest.fixture(scope="module")
def grid(spark):
    return spark.range(2 ** (2 * W)).selectExpr(f"id & {M} as x", f"shiftright(id, {W}) as y").cache()


def test_values(grid):
    words = Words(W)
    rows = grid.select("x", "y", *[F.expr(words.op(n, "x", "y")).alias(n) for n in PLAIN], *[F.expr(words.op(n, "x")).alias(n) for n in UNARY]).collect()
    for r in rows:
        for n, f in PLAIN.items():
            assert r[n] == f(r.x, r.y), (n, r.x, r.y)
        for n, f in UNARY.items():
            assert r[n] == f(r.x), (n, r.x)


def test_poison(grid):
    rows = grid.select("x", "y", *[F.expr(compiled((o, "x", "y", f), W).poison).alias(f"{o}_{f}") for o, f in FLAGS]).collect()
    for r in rows:
        for (o, f), want in FLAGS.items():
            assert r[f"{o}_{f}"] == want(r.x, r.y), (o, f, r.x, r.y)


def test_wide_multiplication_and_funnel(spark):
    a, b, c = 0xFFFFFFFF, 0xDEADBEEF, 37
    words = Words(32)
    row = spark.range(1).select(F.expr(words.op("mul", f"{a}L", f"{b}L")).alias("m"), F.expr(words.op("fshl", f"{a}L", f"{b}L", f"{c}L")).alias("f"), F.expr(words.op("bswap", f"{b}L")).alias("s")).first()
    assert row.m == a * b % 2**32
    assert row.f == ((a << 5) | (b >> 27)) & 0xFFFFFFFF
    assert row.s == 0xEFBEADDE


def test_what_is_not_supported():
    for bad in (lambda: Words(33), lambda: Words(8).op("rotate", "x"), lambda: compiled(("add", "x", "y", "exact"), 8), lambda: compiled(300, 8), lambda: compiled(("trunc", 16, "x"), 8), lambda: compiled(("add", ("zext", 16, "x"), "y"), 8)):
        with pytest.raises(Unsupported):
            bad()
    assert variables(("add", ("mul", "y", 3, "nsw"), "x")) == ["x", "y"]
    assert set(COMPARE) >= {"eq", "ult", "sge"}
