"""Queries over lanes of vectors, masks, scalable blocks, per-lane poison, 32-bit floats and 64-bit words, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import wide
from .functions.words import COMPARE, DUCKDB, SPARK, Words
from .operators import lanes
from .registry import _BUCKETS_SQL, _buckets, _table, drawn, drawn_sql, query

_B, _D = Words(8, SPARK), Words(8, DUCKDB)
_V = f"with d as (select vec_id, {_BUCKETS_SQL} as v from embeddings)"
_OTHER = "v[65 - i]"  # the lane at the other end, in DuckDB


def _lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", _buckets().alias("v")).withColumn("r", F.reverse("v"))


def _zip(text: str) -> Column:
    """SQL text over lanes x and y of a vector and its reverse."""
    return F.expr(f"zip_with(v, r, (x, y) -> {text})")


_OPS = ("add", "sub", "mul", "xor", "and", "or", "shl", "lshr", "ashr")


@query("vec_arith", f"{_V} select vec_id, " + ", ".join(f"list_transform(v, lambda x, i: {_D.op(o, 'x', _OTHER)}) as {o}_lanes" for o in _OPS) + " from d")
def _arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lanes(spark, sf_dir).select("vec_id", *[_zip(_B.op(o, "x", "y")).alias(f"{o}_lanes") for o in _OPS])


_EXTREMES = ("smin", "smax", "umin", "umax")


@query("vec_minmax", f"{_V} select vec_id, " + ", ".join(f"list_transform(v, lambda x, i: {_D.op(o, 'x', _OTHER)}) as {o}_lanes" for o in _EXTREMES) + " from d")
def _minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lanes(spark, sf_dir).select("vec_id", *[_zip(_B.op(o, "x", "y")).alias(f"{o}_lanes") for o in _EXTREMES])


@query("vec_compare", f"{_V} select vec_id, " + ", ".join(f"list_transform(v, lambda x, i: {_D.test(o, 'x', _OTHER)}) as {o}_mask" for o in COMPARE) + " from d")
def _compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lanes(spark, sf_dir).select("vec_id", *[_zip(_B.test(o, "x", "y")).alias(f"{o}_mask") for o in COMPARE])


_SEXT = "((x - case when x >= 128 then 256 else 0 end) & 65535)"


@query("vec_casts", f"{_V} select vec_id, v as zext_lanes, list_transform(v, lambda x: {_SEXT}) as sext_lanes, list_transform(v, lambda x: x & 15) as trunc_lanes, list_transform(v, lambda x: {_D.op('abs', 'x')}) as abs_lanes from d")
def _casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wider = Words(16, SPARK)
    return _lanes(spark, sf_dir).select("vec_id", F.col("v").alias("zext_lanes"), F.expr(f"transform(v, x -> {wider.wrap(_B.signed('x'))})").alias("sext_lanes"), F.expr("transform(v, x -> x & 15)").alias("trunc_lanes"), F.expr(f"transform(v, x -> {_B.op('abs', 'x')})").alias("abs_lanes"))


@query("vec_lanes", f"{_V} select vec_id, v[1] as first, v[64] as last, list_transform(range(0, 64), lambda i: v[5]) as splat, list_transform(v, lambda x, i: case when i = 64 then v[1] else x end) as inserted from d")
def _extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return _lanes(spark, sf_dir).select("vec_id", v[0].alias("first"), v[63].alias("last"), F.array_repeat(v[4], 64).alias("splat"), lanes.inserted(v, 63, v[0]).alias("inserted"))


@query("vec_masks", f"{_V}, m as (select vec_id, list_transform(v, lambda x, i: x < {_OTHER}) as a, list_transform(v, lambda x: x % 2 = 0) as b from d) select vec_id, list_transform(a, lambda x: not x) as inverse, list_transform(a, lambda x, i: x and b[i]) as both_set, list_transform(a, lambda x, i: x or b[i]) as either_set, list_transform(a, lambda x, i: case when x then b[i] else not b[i] end) as picked from m")
def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _lanes(spark, sf_dir).select("vec_id", _zip("x < y").alias("a"), F.expr("transform(v, x -> x % 2 = 0)").alias("b"))
    a, b = F.col("a"), F.col("b")
    return m.select("vec_id", F.transform(a, lambda x: ~x).alias("inverse"), lanes.zipped(a, b, lambda x, y: x & y).alias("both_set"), lanes.zipped(a, b, lambda x, y: x | y).alias("either_set"), lanes.chosen(a, b, F.transform(b, lambda x: ~x)).alias("picked"))


_FOLDS = {"add": ("0", "(a + x) & 255"), "mul": ("1", "(a * x) & 255"), "and": ("255", "a & x"), "or": ("0", "a | x")}


@query("vec_folds", f"{_V}, s as (select vec_id, v, list_transform(v, lambda x: x - case when x >= 128 then 256 else 0 end) as w from d) select vec_id, " + ", ".join(f"list_reduce(v, lambda a, x: {t}, {z}::BIGINT)::BIGINT as {n}_fold" for n, (z, t) in _FOLDS.items()) + ", list_reduce(v, lambda a, x: xor(a, x), 0::BIGINT)::BIGINT as xor_fold, list_min(w) & 255 as smin_fold, list_max(w) & 255 as smax_fold, list_min(v) as umin_fold, list_max(v) as umax_fold from s")
def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _lanes(spark, sf_dir).withColumn("w", F.expr(f"transform(v, x -> {_B.signed('x')})"))
    folds = [F.expr(f"aggregate(v, {z}L, (a, x) -> {t})").alias(f"{n}_fold") for n, (z, t) in (_FOLDS | {"xor": ("0", "a ^ x")}).items()]
    return d.select("vec_id", *folds, F.array_min("w").bitwiseAND(F.lit(255)).alias("smin_fold"), F.array_max("w").bitwiseAND(F.lit(255)).alias("smax_fold"), F.array_min("v").alias("umin_fold"), F.array_max("v").alias("umax_fold"))


# Scalable vectors: sixteen blocks of four lanes.
_MASK, _INDEX = [1, 0, 3, 2], [2, -1, 0, -1]


@query("scalable_shuffle", f"{_V} select vec_id, list_transform(v, lambda x, i: v[(i - 1) // 4 * 4 + {_MASK}[(i - 1) % 4 + 1] + 1]) as permuted, list_transform(v, lambda x, i: case when {_INDEX}[(i - 1) % 4 + 1] < 0 then x else v[(i - 1) // 4 * 4 + {_INDEX}[(i - 1) % 4 + 1] + 1] end) as gathered from d")
def _scalable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lanes(spark, sf_dir).select("vec_id", lanes.by_block(F.col("v"), _MASK).alias("permuted"), lanes.by_block(F.col("v"), _INDEX).alias("gathered"))


@query("scalable_mask_program", f"{_V} select vec_id, list_transform(v, lambda x, i: case (i - 1) % 4 when 0 then true when 1 then x < 100 when 2 then not (x < 100 and {_OTHER} > 50) else case when x > {_OTHER} then x % 2 = 0 else {_OTHER} % 2 = 0 end end) as mask from d")
def _program(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = ["true", "x < 100", "not (x < 100 and y > 50)", "if(x > y, x % 2 = 0, y % 2 = 0)"]
    return _lanes(spark, sf_dir).select("vec_id", lanes.mask_program("v", "r", tests).alias("mask"))


_SCALES = [1, 2, 4, 8]


@query("scalable_instances", f"{_V}, s as (select vec_id, v, unnest({_SCALES}) as vscale from d) select vscale::BIGINT as vscale, count(*) as points, count(*) as proofs, count(*) filter (list_transform(v[1:vscale * 4], lambda x, i: v[(i - 1) // 4 * 4 + [1, 0, 3, 2][(i - 1) % 4 + 1] + 1]) <> v[1:vscale * 4]) as teeth from s group by 1")
def _instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block permutation made twice is nothing, at every number of blocks; made once it isn't: where that shows are the teeth."""
    s = _lanes(spark, sf_dir).select("v", F.explode(F.lit(_SCALES)).alias("vscale"))
    part = s.select(F.col("vscale").cast("bigint").alias("vscale"), F.slice("v", F.lit(1), F.col("vscale") * 4).alias("w")).withColumn("once", lanes.by_block(F.col("w"), _MASK))
    part = part.withColumn("twice", lanes.by_block(F.col("once"), _MASK))
    return part.groupBy("vscale").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("twice") == F.col("w")).alias("proofs"), F.count_if(F.col("once") != F.col("w")).alias("teeth"))


@query("vec_lane_poison", f"{_V} select vec_id, (len(list_filter(list_transform(v, lambda x, i: x + {_OTHER} > 255), lambda p: p)))::BIGINT as poison_lanes, 0::BIGINT as bad_dropping, (len(list_filter(list_transform(v, lambda x, i: x + {_OTHER} > 255), lambda p: p)))::BIGINT as bad_adding from d")
def _lane_poison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes of (value, poison): where the source lane is defined, the target lane has to be, and equal. Dropping nuw refines, adding it doesn't."""
    d = _lanes(spark, sf_dir).withColumn("w", F.expr("transform(v, x -> cast(cast(x as string) as bigint))"))  # the target's own lanes
    value, poison = _B.op("add", "x", "y"), " or ".join(_B.poison("add", frozenset({"nuw"}), "x", "y"))
    flagged = d.select("vec_id", F.expr(f"zip_with(v, r, (x, y) -> struct({value} as v, {poison} as p))").alias("a"), F.expr(f"zip_with(w, r, (x, y) -> struct({value} as v, false as p))").alias("b"))
    count = lambda lanes_: F.size(F.filter(lanes_, lambda x: x)).cast("bigint")
    bad = lambda s, t: count(F.zip_with(s, t, lambda x, y: ~x.p & (y.p | (x.v != y.v))))
    return flagged.select("vec_id", count(F.transform("a", lambda x: x.p)).alias("poison_lanes"), bad("a", "b").alias("bad_dropping"), bad("b", "a").alias("bad_adding"))


_REDUCE = {"add": "(({a}) + ({b})) & 3", "mul": "(({a}) * ({b})) & 3", "sub": "(({a}) - ({b})) & 3"}


def _chain(op: str, xs: list[str]) -> str:
    out = xs[0]
    for x in xs[1:]:
        out = "(" + _REDUCE[op].format(a=out, b=x) + ")"
    return out


def _tree(op: str, xs: list[str]) -> str:
    return "(" + _REDUCE[op].format(a=_chain(op, xs[:2]), b=_chain(op, xs[2:])) + ")"


_XS = ["x0", "x1", "x2", "x3"]


@query("reduction_contract", f"with g as (select {', '.join(f'(i >> {2 * k}) & 3 as {x}' for k, x in enumerate(_XS))} from {drawn_sql(256)}) " + " union all ".join(f"select '{o}' as op, count(*) as n_rows, count(*) filter ({_chain(o, _XS)} <> {_tree(o, _XS)}) as violations from g" for o in _REDUCE))
def _reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain and a balanced tree over four lanes; the tree's lanes went through text."""
    g = drawn(spark, sf_dir, 256).selectExpr(*[f"shiftright(id, {2 * k}) & 3 as {x}" for k, x in enumerate(_XS)])
    g = g.selectExpr("*", *[f"cast(cast({x} as string) as bigint) as {x}_t" for x in _XS])
    rows = F.array(*[F.struct(F.lit(o).alias("op"), F.expr(f"{_chain(o, _XS)} <> {_tree(o, [x + '_t' for x in _XS])}").alias("bad")) for o in _REDUCE])
    return g.select(F.inline(rows)).groupBy("op").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("bad").alias("violations"))


def _halves_sql(v: str, n: int) -> str:
    """A balanced sum in DuckDB: halves are added lane by lane until one is left."""
    while n > 1:
        n //= 2
        v = f"list_transform(range(1, {n + 1}), lambda i{n}: ({v})[i{n}] + ({v})[i{n} + {n}])"
    return f"({v})[1]"


@query("fp_reduce", "with d as (select vec_id, embedding as e from embeddings), " + ", ".join(f"h{n} as (select *, list_transform(range(1, {n + 1}), lambda i: {v}[i] + {v}[i + {n}]) as h{n} from {d})" for n, v, d in ((32, "e", "d"), (16, "h32", "h32"), (8, "h16", "h16"), (4, "h8", "h8"), (2, "h4", "h4"))) + " select vec_id, list_reduce(e, lambda a, x: a + x, 0::FLOAT)::DOUBLE as chain, list_reduce(e, lambda a, x: a * x, 1::FLOAT)::DOUBLE as product, list_reduce(e, lambda a, x: a - x, 0::FLOAT)::DOUBLE as difference, (h2[1] + h2[2])::DOUBLE as tree from h2")
def _fp_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered folds of 32-bit floats over all lanes, and a tree over them, which rounds otherwise."""
    d = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("e"))
    one = lambda x: F.lit(x).cast("float")
    plus = lambda a, x: a + x
    return d.select("vec_id", lanes.folded(F.col("e"), one(0), plus).cast("double").alias("chain"), lanes.folded(F.col("e"), one(1), lambda a, x: a * x).cast("double").alias("product"), lanes.folded(F.col("e"), one(0), lambda a, x: a - x).cast("double").alias("difference"), lanes.balanced(F.col("e"), 64, plus).cast("double").alias("tree"))


_FLOATS = ["0.0", "-0.0", "1.0", "-1.0", "1.5e38", "3.0e38", "Infinity", "-Infinity", "NaN"]
_FLOAT_SQL = ", ".join(f"('{x}', '{y}')" for x in _FLOATS for y in _FLOATS)
_KIND = "case when isnan({v}) then 'nan' when isinf({v}) then case when {v} > 0 then 'inf' else '-inf' end when cast({v} as varchar) = '-0.0' then '-0' else 'finite' end"
_FP = {"fpadd": "a + b", "fpsub": "a - b", "fpmul": "a * b"}


@query("fp_semantics", f"with t as (select * from (values {_FLOAT_SQL}) v(x, y) union select l_quantity::VARCHAR, l_linenumber::VARCHAR from lineitem), f as (select x, y, x::FLOAT as a, y::FLOAT as b from t), " + "r as (" + " union all ".join(f"select '{o}' as op, x, y, a, b, ({e})::FLOAT as v from f" for o, e in _FP.items()) + " union all select 'fpneg', x, y, a, b, (-a)::FLOAT from f) select op, x, y, " + _KIND.format(v="v") + " as kind, (isnan(a) or isnan(b) or isnan(v)) as nnan_poison, (isinf(a) or isinf(b) or isinf(v)) as ninf_poison from r")
def _fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, differences, products and signs of 32-bit floats, which kind they are, and when the flags against NaN and infinity make poison."""
    t = spark.createDataFrame([(x, y) for x in _FLOATS for y in _FLOATS], "x string, y string")
    t = t.unionByName(_table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("string").alias("x"), F.col("l_linenumber").cast("string").alias("y"))).distinct().select("x", "y", F.col("x").cast("float").alias("a"), F.col("y").cast("float").alias("b"))
    rows = F.array(*[F.struct(F.lit(o).alias("op"), F.expr(e).alias("v")) for o, e in (_FP | {"fpneg": "-a"}).items()])
    r = t.select("x", "y", "a", "b", F.explode(rows).alias("r")).select("r.op", "x", "y", "a", "b", "r.v")
    endless = lambda c: F.abs(F.col(c)) == F.lit(float("inf")).cast("float")
    kind = F.when(F.isnan("v"), "nan").when(endless("v"), F.when(F.col("v") > 0, "inf").otherwise("-inf")).when(F.col("v").cast("string") == "-0.0", "-0").otherwise("finite")
    return r.select("op", "x", "y", kind.alias("kind"), (F.isnan("a") | F.isnan("b") | F.isnan("v")).alias("nnan_poison"), (endless("a") | endless("b") | endless("v")).alias("ninf_poison"))


_FAST = {"add-negated": ("x + (-x)", False), "sub-self": ("x - x", False), "add-negated-nnan-ninf": ("x + (-x)", True), "sub-self-nnan-ninf": ("x - x", True), "add-one": ("x + 1 - x", True)}
_FAST_SQL = " union all ".join(f"select '{n}' as rule, count(*) filter (not {'(isnan(x) or isinf(x))' if flags else 'false'}) as n_rows, count(*) filter (not {'(isnan(x) or isinf(x))' if flags else 'false'} and not coalesce(({e}) = 0 and not isnan({e}), false)) as violations from f" for n, (e, flags) in _FAST.items())


@query("verify_fast_math", f"with f as (select v::FLOAT as x from (values {', '.join(f'({chr(39)}{x}{chr(39)})' for x in _FLOATS)}) t(v) union all select l_quantity::FLOAT from lineitem) {_FAST_SQL}")
def _fast_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does it give zero? Without flags NaN and infinity are against it; flags take them out."""
    f = spark.createDataFrame([(x,) for x in _FLOATS], "v string").select(F.col("v").cast("float").alias("x"))
    f = f.unionByName(_table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("float").alias("x")))
    odd = F.isnan("x") | (F.abs("x") == F.lit(float("inf")).cast("float"))
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), (~odd if flags else F.lit(True)).alias("ok"), F.expr(f"not (({e}) = 0 and not isnan({e}))").alias("bad")) for n, (e, flags) in _FAST.items()])
    return f.select(F.inline(rows)).groupBy("rule").agg(F.count_if("ok").alias("n_rows"), F.count_if(F.col("ok") & F.col("bad")).alias("violations"))


# ---- 64-bit words

_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_A, _BB = "l_orderkey * 1000003 * (l_partkey * 8191 + 1) - 4611686018427387", "l_suppkey * 16777259 * (case when l_linenumber % 2 = 0 then -1 else 1 end) * (l_partkey % 1000)"
_U = "(case when {x} < 0 then {x}::HUGEINT + 18446744073709551616::HUGEINT else {x}::HUGEINT end)"
_S = "(case when {x} >= 9223372036854775808::HUGEINT then {x} - 18446744073709551616::HUGEINT else {x} end)::BIGINT"
_UA, _UB, _M64 = _U.format(x="a"), _U.format(x="b"), "18446744073709551616::HUGEINT"
_D64 = f"with d as (select {', '.join(_KEYS)}, {_A} as a, {_BB} as b, (l_linenumber * 11)::BIGINT as n from lineitem)"


def _wide_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and the words a, b and n: the SQL's products, which wrap where larger keys take them past 63 bits. Each step has columns of its own, so that its text isn't repeated."""
    d = _table(spark, sf_dir, "lineitem").selectExpr(*_KEYS, f"{wide.mul('l_orderkey', '1000003L')} as o", f"{wide.mul('l_partkey', '8191L')} as p", f"{wide.mul('l_suppkey', '16777259L')} as s", "(case when l_linenumber % 2 = 0 then -1L else 1L end) * (l_partkey % 1000) as c")
    d = d.selectExpr(*_KEYS, "o", f"{wide.add('p', '1L')} as p", f"{wide.mul('s', 'c')} as b")
    d = d.selectExpr(*_KEYS, f"{wide.mul('o', 'p')} as op", "b")
    return d.selectExpr(*_KEYS, f"{wide.add('op', '-4611686018427387L')} as a", "b", "cast(l_linenumber * 11 as bigint) as n")


# the product by halves, so that HUGEINT holds it
_MUL_SQL = f"((({_UA} % 4294967296) * {_UB} + ((({_UA} // 4294967296) * ({_UB} % 4294967296)) % 4294967296) * 4294967296) % {_M64})"


@query("bv_mul64_limbs", f"{_D64} select {', '.join(_KEYS)}, {_S.format(x=_MUL_SQL)} as v from d")
def _mul64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide_words(spark, sf_dir).selectExpr(*_KEYS, f"{wide.mul('a', 'b')} as v")


_WORD64 = {
    "added": f"(({_UA} + {_UB}) % {_M64})", "subtracted": f"(({_UA} - {_UB} + {_M64}) % {_M64})",
    "shl": f"(({_UA} % (1::HUGEINT << (64 - least(n, 64))::INT)) * (1::HUGEINT << (least(n, 63))::INT) * (case when n >= 64 then 0 else 1 end))",
    "lshr": f"(case when n >= 64 then 0::HUGEINT else {_UA} >> n::INT end)", "udiv": f"(case when b = 0 then {_M64} - 1 else {_UA} // (case when b = 0 then 1::HUGEINT else {_UB} end) end)",
}


@query("bv_word64", f"{_D64} select {', '.join(_KEYS)}, {', '.join(f'{_S.format(x=x)} as {n}' for n, x in _WORD64.items())}, {_UA} < {_UB} as ult, a < b as slt from d")
def _word64(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = wide.with_quotient(_wide_words(spark, sf_dir), "a", "b", "udiv")
    return d.selectExpr(*_KEYS, f"{wide.add('a', 'b')} as added", f"{wide.sub('a', 'b')} as subtracted", f"{wide.less('a', 'b')} as ult", "a < b as slt", f"{wide.shifted_left('a', 'n')} as shl", f"{wide.shifted_right('a', 'n')} as lshr", "udiv")
