"""All registered queries of the engine with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import seeds
from .functions.words import DUCKDB, SPARK
from .operators import graph, graphs, lanes, ordered, records, search, text
from .plans import verify
from .plans.expression import compiled

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_KEYS = ", ".join(KEYS)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return put


# ---- machine-integer operations over lineitem: x, y, z are the low bits of its keys

def _inputs(width: int) -> tuple[str, str]:
    """Projections of lineitem to keys and variables, for Spark and DuckDB."""
    wide = 2**width - 1
    x, y, z = ("l_orderkey * 2654435761", "l_partkey * 40503", "l_suppkey * 65599") if width > 8 else ("l_orderkey", "l_partkey", "l_suppkey")
    cols = [f"cast(({e}) & {wide} as bigint) as {n}" for e, n in ((x, "x"), (y, "y"), (z, "z"))]
    return f"select {_KEYS}, {', '.join(cols)} from lineitem", ", ".join(cols)


def _word(name: str, tree: object, width: int = 8, poisonable: tuple[str, ...] = ()) -> None:
    """Register a query that evaluates a tree over lineitem: keys, value v, poison p."""
    base, cols = _inputs(width)
    flags = [f"({v} % 7 = 3) as {v}_poison" for v in poisonable]
    held = frozenset(poisonable)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        value, poison, _ = compiled(tree, width, SPARK, held)
        rows = _table(spark, sf_dir, "lineitem").selectExpr(*KEYS, *cols.split(", cast")[:1], *["cast" + c for c in cols.split(", cast")[1:]])
        rows = rows.selectExpr("*", *flags) if flags else rows
        return rows.selectExpr(*KEYS, f"cast({value} as bigint) as v", f"({poison}) as p")

    value, poison, _ = compiled(tree, width, DUCKDB, held)
    query(name, f"with b as ({base}), d as (select *{''.join(', ' + f for f in flags)} from b) select {_KEYS}, cast({value} as bigint) as v, ({poison}) as p from d")(run)


X, Y, Z = "x", "y", "z"
for _op in ("add", "sub", "mul", "and", "or", "xor", "shl", "lshr", "ashr", "udiv", "urem", "sdiv", "srem"):
    _word(f"bv_{_op}8", (_op, X, Y))
for _op in ("add", "sub", "mul", "shl", "udiv", "srem", "xor"):
    _word(f"bv_{_op}32", (_op, X, Y), 32)
for _op in ("eq", "ne", "ult", "ule", "ugt", "uge", "slt", "sle", "sgt", "sge"):
    _word(f"bv_{_op}", (_op, X, Y))
for _op in ("umin", "umax", "smin", "smax", "uadd_sat", "usub_sat", "sadd_sat", "ssub_sat"):
    _word(f"bv_{_op}", (_op, X, Y))
for _op in ("neg", "not", "abs", "ctpop", "ctlz", "cttz", "bitreverse"):
    _word(f"bv_{_op}", (_op, X))
_word("bv_bswap32", ("bswap", X), 32)
_word("bv_fshl", ("fshl", X, Y, Z))
_word("bv_fshr", ("fshr", X, Y, Z))
_word("bv_zext", ("zext", 16, X))
_word("bv_sext", ("sext", 16, X))
_word("bv_trunc", ("trunc", 4, X))
_word("bv_select_poison", ("select", ("ult", X, Y), ("add", X, Z), Y), poisonable=("x", "y"))
_word("bv_nested", ("xor", ("mul", ("add", X, Y), 5), ("lshr", Z, 3)))
_FLAGGED = [("add", "nsw"), ("add", "nuw"), ("sub", "nsw"), ("sub", "nuw"), ("mul", "nsw"), ("mul", "nuw"), ("shl", "nsw"), ("shl", "nuw"), ("lshr", "exact"), ("ashr", "exact"), ("udiv", "exact"), ("sdiv", "exact"), ("or", "disjoint"), ("shl", "inrange")]
_COLS8 = _inputs(8)


def _flag_sql() -> str:
    parts = [f"select '{o}' as op, '{f}' as flag, count(*) filter ({compiled((o, X, Y, f), 8, DUCKDB).poison}) as n_poison, count(*) as n from d" for o, f in _FLAGGED]
    return f"with d as ({_COLS8[0]}) {' union all '.join(parts)}"


@query("bv_flags_matrix", _flag_sql())
def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey & 255 as x", "l_partkey & 255 as y")
    counts = d.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.expr(compiled((o, X, Y, f), 8).poison)).alias(f"c{i}") for i, (o, f) in enumerate(_FLAGGED)])
    rows = F.explode(F.array(*[F.struct(F.lit(o).alias("op"), F.lit(f).alias("flag"), F.col(f"c{i}").alias("n_poison")) for i, (o, f) in enumerate(_FLAGGED)]))
    return counts.select("n", rows.alias("r")).select("r.op", "r.flag", "r.n_poison", "n")


# ---- verification: the inputs are those that rows of lineitem stand for

_PLACE = "((l_orderkey % 1000003) * 40503 + (l_partkey % 1000003) * 65599 + (l_suppkey % 1000003) * 97 + l_linenumber)"


def drawn(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """id: the numbers below ``n`` that rows of lineitem fall on, each once; all of them, once the table is much longer than ``n``."""
    return places(spark, sf_dir, n).distinct()


def places(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """id: the number below ``n`` that each row of lineitem falls on."""
    return _table(spark, sf_dir, "lineitem").select(F.expr(f"cast({_PLACE} % {n} as bigint)").alias("id")).where("id is not null")


def drawn_sql(n: int, name: str = "i") -> str:
    return f"(select distinct ({_PLACE} % {n})::BIGINT from lineitem where {_PLACE} is not null) t({name})"


def counted_sql(n: int) -> str:
    """All numbers below ``n`` once, and those that rows of lineitem fall on with how many rows."""
    return f"(select i, 1 as n, 0 as met from range({n}) r(i) union all select ({_PLACE} % {n})::BIGINT, 0, count(*) from lineitem where {_PLACE} is not null group by 1) t"


def sampled(spark: SparkSession, sf_dir: str, width: int, names: tuple[str, ...] = ("x", "y"), poison: tuple[str, ...] = ()) -> DataFrame:
    """Assignments of variables, cut from the numbers of drawn()."""
    return verify.exhaustive(spark, width, names, poison, drawn(spark, sf_dir, 2 ** (width * len(names) + len(poison))))


def whole(spark: SparkSession, sf_dir: str, width: int, names: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """All assignments of variables, and those that rows of lineitem stand for."""
    return verify.whole(places(spark, sf_dir, 2 ** (width * len(names))), width, names)


def whole_sql(width: int, names: tuple[str, ...] = ("x", "y")) -> str:
    return f"select {', '.join(f'(i >> {width * k}) & {2**width - 1} as {v}' for k, v in enumerate(names))}, n, met from {counted_sql(2 ** (width * len(names)))}"


_GRID = f"select i & 255 as x, (i >> 8) & 255 as y from {drawn_sql(65536)}"
_SETS = {
    "identities": verify.IDENTITIES, "negatives": verify.NEGATIVES, "flags": verify.FLAGS, "guarded": verify.GUARDED, "lift_rules": verify.LIFTED, "multi_instruction": verify.STEPS, "ub": verify.UNDEFINED,
    "interprocedural": verify.CALLS, "branches": verify.BRANCHES,
}
_WHOLE = ("identities", "flags", "guarded", "lift_rules", "multi_instruction", "ub", "interprocedural", "branches")  # sets that are checked on all inputs, besides those of rows
for _name, _rules in _SETS.items():

    def _run(spark: SparkSession, sf_dir: str, rules: list = _rules, all_: bool = _name in _WHOLE) -> DataFrame:
        return verify.verdicts(whole(spark, sf_dir, 8), rules, 8, met=True) if all_ else verify.verdicts(sampled(spark, sf_dir, 8), rules, 8, drawn=True)

    query(f"verify_{_name}", verify.verdicts_sql(whole_sql(8), _rules, 8, met=True) if _name in _WHOLE else verify.verdicts_sql(_GRID, _rules, 8, drawn=True))(_run)

_XYZ = ("x", "y", "z")


@query("verify_three_variables", verify.verdicts_sql(whole_sql(8, _XYZ), verify.TRIPLES, 8, _XYZ, met=True))
def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.verdicts(whole(spark, sf_dir, 8, _XYZ), verify.TRIPLES, 8, _XYZ, met=True)


_POISON_GRID = f"select i & 15 as x, (i >> 4) & 15 as y, ((i >> 8) & 1) = 1 as x_poison, ((i >> 9) & 1) = 1 as y_poison from {drawn_sql(1024)}"


@query("verify_poison_states", verify.verdicts_sql(_POISON_GRID, verify.POISONED, 4, poison=("x", "y"), drawn=True))
def _poisoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.verdicts(sampled(spark, sf_dir, 4, poison=("x", "y")), verify.POISONED, 4, poison=("x", "y"), drawn=True)


_WIDTHS = (4, 8, 12)  # a constant that doesn't fit a width isn't carried to it
_CARRIED = [verify.Rule(r.name, r.before, r.after) for r in verify.LIFTED + verify.NEGATIVES]


def _at_width(width: int) -> list:
    """Rules whose constants fit a width."""
    def fits(tree: object) -> bool:
        return tree < 2**width if isinstance(tree, int) else isinstance(tree, str) or all(fits(x) for x in tree[1:])

    return [r for r in _CARRIED if fits(r.before) and fits(r.after)]


_WIDTH_SQL = " union all ".join(f"select '{r.name}' as rule, {w}::BIGINT as width, 'non-portable' as status" for w in _WIDTHS for r in _CARRIED if r not in _at_width(w))
_WIDTH_SQL += " union all " + " union all ".join(f"select rule, {w}::BIGINT as width, status from ({verify.verdicts_sql(f'select i & {2**w - 1} as x, (i >> {w}) & {2**w - 1} as y from {drawn_sql(2 ** (2 * w))}', _at_width(w), w, drawn=True)})" for w in _WIDTHS)


@query("verify_widths", _WIDTH_SQL)
def _widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule at several widths, over the inputs that are drawn; constants that don't fit are said to be not portable."""
    out = None
    for w in _WIDTHS:
        some = drawn(spark, sf_dir, 2 ** (2 * w)).selectExpr(f"id & {2**w - 1} as x", f"shiftright(id, {w}) & {2**w - 1} as y", "1L as n")
        here = verify.verdicts(some, _at_width(w), w, drawn=True).select("rule", F.lit(w).cast("bigint").alias("width"), "status")
        out = here if out is None else out.unionByName(here)
    left = [(r.name, w, "non-portable") for w in _WIDTHS for r in _CARRIED if r not in _at_width(w)]
    return out.unionByName(spark.createDataFrame(left, "rule string, width bigint, status string"))


_FLAGSHIP = [verify.Rule("xor-self", ("xor", X, X), 0), verify.Rule("add-one-identity", ("add", X, 1), X)]


@query("verify_on_table", verify.verdicts_sql("select l_orderkey & 255 as x, l_partkey & 255 as y from lineitem", _FLAGSHIP, 8))
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey & 255 as x", "l_partkey & 255 as y")
    return verify.verdicts(verify.observed(d), _FLAGSHIP, 8)


_ATOMS = {"x<128": "x < 128", "y<128": "y < 128", "y>0": "y > 0", "x=y": "x = y", "even": "x % 2 = 0"}
_BAD = {d: f"({compiled(('sdiv', X, Y), 8, e).value} <> {compiled(('udiv', X, Y), 8, e).value})" for d, e in (("spark", SPARK), ("duck", DUCKDB))}


def _guard_sql() -> str:
    from itertools import combinations

    sets = [c for k in (1, 2, 3) for c in combinations(_ATOMS, k)]
    hold = lambda s: " and ".join(f"({_ATOMS[a]})" for a in s)
    sums = {"covered": ("n", ""), "leaks": ("n", " and bad"), "rows_met": ("met", ""), "leaks_met": ("met", " and bad")}
    parts = [f"select '{'&'.join(s)}' as guards, {', '.join(f'coalesce(sum({of}) filter ({hold(s)}{test}), 0)::BIGINT as {c}' for c, (of, test) in sums.items())} from d" for s in sets]
    return f"with g as ({whole_sql(8)}), d as (select x, y, n, met, {_BAD['duck']} as bad from g) select *, covered > 0 and leaks = 0 as works from ({' union all '.join(parts)})"


@query("guard_inference", _guard_sql())
def _guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.guards(whole(spark, sf_dir, 8), _BAD["spark"], _ATOMS, 3, met=True)


@query("assumption_normalize", "select l_suppkey as name, bit_or(l_orderkey & 15) as zeros, bit_or(l_partkey & 240) as ones, (bit_or(l_orderkey & 15) & bit_or(l_partkey & 240)) <> 0 as contradiction from lineitem group by 1")
def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.merged_facts(_table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as name", "l_orderkey & 15 as zeros", "l_partkey & 240 as ones"))


@query("truth_tables", f"""with d as (select (i & 1) = 1 as a, (i & 2) = 2 as b, (i & 4) = 4 as c from {drawn_sql(8)}) select 'if-conversion' as contract, bool_and((case when a then b else c end) = ((a and b) or (not a and c))) as holds, count(*) as n_rows from d
union all select 'dead-code', bool_and(not (a and b) or b), count(*) from d union all select 'hoist-unsafe', bool_and(not a or b), count(*) from d""")
def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = drawn(spark, sf_dir, 8).selectExpr("(id & 1) = 1 as a", "(id & 2) = 2 as b", "(id & 4) = 4 as c")
    goals = {"if-conversion": "(if(a, b, c)) = ((a and b) or (not a and c))", "dead-code": "not (a and b) or b", "hoist-unsafe": "not a or b"}
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("contract"), F.expr(g).alias("ok")) for n, g in goals.items()]))
    return d.select(rows.alias("r")).groupBy("r.contract").agg(F.bool_and("r.ok").alias("holds"), F.count(F.lit(1)).alias("n_rows"))


@query("freeze_quantifier", f"with g as (select i & 15 as x, (i >> 4) & 15 as c, (i >> 8) & 15 as s from {drawn_sql(4096)}), per as (select x, c, bool_and(c <> s) as bad from g group by all) select x, bool_or(bad) as refuted from per group by x")
def _freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sampled(spark, sf_dir, 4, ("x", "c", "s"))
    return g.groupBy("x", "c").agg(F.bool_and(F.col("c") != F.col("s")).alias("bad")).groupBy("x").agg(F.bool_or("bad").alias("refuted"))


@query("closed_form_check", f"with g as (select i as n from {drawn_sql(200)}), s as (select n, (select coalesce(sum(k), 0) from range(n) r(k)) as loop_sum from g) select n, loop_sum::BIGINT as loop_sum, loop_sum = n * (n - 1) // 2 as agrees from s")
def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = drawn(spark, sf_dir, 200).select(F.col("id").alias("n"))
    total = F.when(F.col("n") > 0, F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0).cast("bigint"), lambda a, k: a + k)).otherwise(0)
    return n.select("n", total.alias("loop_sum"), (total == F.expr("n * (n - 1) div 2")).alias("agrees"))


@query("poly_grid", f"with c as (select a - 3 as a, b - 3 as b from range(7) t(a), range(7) u(b)), g as (select i as n from {drawn_sql(64)}) select a, b, bool_and(2 * (n * (n - 1) // 2) = a * n * n + b * n) as fits from c, g group by all")
def _poly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """49 candidates at each drawn point."""
    c = drawn(spark, sf_dir, 64).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(48).cast("bigint"))).alias("id"))
    return c.selectExpr("n", "id div 7 - 3 as a", "id % 7 - 3 as b").groupBy("a", "b").agg(F.bool_and(F.expr("2 * (n * (n - 1) div 2) = a * n * n + b * n")).alias("fits"))


_MIX_SQL = seeds.mixed("s", DUCKDB)


@query("seeded_configs", f"with d as (select i as seed, k, (i * 31 + k) & 4294967295 as s from (select event_id from events) t(i), range(6) u(k)) select seed, k, {_MIX_SQL} as mixed, ({_MIX_SQL}) % 5 as field from d")
def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "events").select(F.col("event_id").alias("seed"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("k")).withColumn("s", F.expr("(seed * 31 + k) & 4294967295"))
    return d.selectExpr("seed", "k", f"{seeds.mixed('s', SPARK)} as mixed", f"({seeds.mixed('s', SPARK)}) % 5 as field")


@query("normalize_configs", "select event_id, (user_id % 5 + 5) % 5 as kind, event_id & 7 as bits, case when user_id - 20 between -8 and 8 then user_id - 20 else (((user_id - 20) % 17 + 17) % 17) - 8 end as c from events")
def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("user_id") - 20
    return _table(spark, sf_dir, "events").select("event_id", F.pmod("user_id", F.lit(5)).cast("bigint").alias("kind"), F.expr("event_id & 7").alias("bits"), F.when(c.between(-8, 8), c).otherwise(F.pmod(c, F.lit(17)) - 8).cast("bigint").alias("c"))


# ---- lanes

def _buckets() -> Column:
    """The values of a vector as numbers below 256."""
    return F.transform("embedding", lambda x: F.pmod(F.floor(x.cast("double") * 100).cast("bigint"), F.lit(256)).cast("bigint"))


_BUCKETS_SQL = "list_transform(embedding, lambda x: ((floor(x::DOUBLE * 100)::BIGINT % 256) + 256) % 256)"


@query("vec_maps", f"with d as (select vec_id, {_BUCKETS_SQL} as v from embeddings) select vec_id, list_transform(v, lambda x, i: (x + v[65 - i]) & 255) as sums, [v[64], v[1], v[3], v[2]] as shuffled, list_transform(v, lambda x, i: CASE WHEN i = 3 THEN 7 ELSE x END) as placed, list_transform(v, lambda x, i: CASE WHEN x < v[65 - i] THEN x ELSE v[65 - i] END) as chosen from d")
def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "embeddings").select("vec_id", _buckets().alias("v")).withColumn("r", F.reverse("v"))
    v, r = F.col("v"), F.col("r")
    less = lanes.zipped(v, r, lambda a, b: a < b)
    return d.select("vec_id", lanes.zipped(v, r, lambda a, b: (a + b).bitwiseAND(F.lit(255))).alias("sums"), lanes.shuffled(v, v, [63, 0, 2, 1]).alias("shuffled"), lanes.inserted(v, 2, F.lit(7).cast("bigint")).alias("placed"), lanes.chosen(less, v, r).alias("chosen"))


@query("vec_reduce", f"with d as (select vec_id, {_BUCKETS_SQL} as v from embeddings) select vec_id, (list_sum(v) & 255)::BIGINT as total, list_max(v) as top, list_min(v) as low, list_reduce(v, lambda a, x: xor(a, x)) as mixed, (list_sum(v) & 255)::BIGINT as balanced, true as agrees from d")
def _reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "embeddings").select("vec_id", _buckets().alias("v"))
    zero, plus = F.lit(0).cast("bigint"), lambda a, x: (a + x).bitwiseAND(F.lit(255))
    out = d.select("vec_id", lanes.folded(F.col("v"), zero, plus).alias("total"), F.array_max("v").alias("top"), F.array_min("v").alias("low"), lanes.folded(F.col("v"), zero, lambda a, x: a.bitwiseXOR(x)).alias("mixed"), lanes.balanced(F.col("v"), 64, plus).alias("balanced"))
    return out.withColumn("agrees", F.col("total") == F.col("balanced"))  # a chain and a tree


# ---- joins

@query("case_left_join_last_wins", "with s as (select l_orderkey, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) as flag from lineitem group by 1) select o_orderkey, coalesce(flag, 'unknown') as flag from orders left join s on o_orderkey = l_orderkey")
def _left(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = records.last_wins(_table(spark, sf_dir, "lineitem").select(*KEYS, "l_returnflag"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
    return _table(spark, sf_dir, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("l_returnflag", F.lit("unknown")).alias("flag"))


@query("registry_full_outer", "with a as (select distinct c_nationkey as k from customer where c_acctbal > 0), b as (select distinct s_nationkey as k from supplier) select coalesce(a.k, b.k)::BIGINT as k, list_filter([CASE WHEN a.k IS NOT NULL THEN 'customer' END, CASE WHEN b.k IS NOT NULL THEN 'supplier' END], lambda x: x IS NOT NULL) as sources from a full join b on a.k = b.k")
def _outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").cast("bigint").alias("k")).distinct().withColumn("a", F.lit("customer"))
    b = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("bigint").alias("k")).distinct().withColumn("b", F.lit("supplier"))
    return a.join(b, "k", "full_outer").select("k", F.array_compact(F.array("a", "b")).alias("sources"))


@query("marker_explode_join", "with m as (select o_orderkey, unnest(list_distinct([o_orderstatus, substr(o_orderpriority, 1, 1)])) as marker from orders), i as (select l_returnflag as marker, count(*) as n from lineitem group by 1) select marker, count(*) as cases, coalesce(max(n), 0) as intents from m left join i using (marker) group by marker")
def _markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _table(spark, sf_dir, "orders").select(F.explode(F.array_union(F.array("o_orderstatus"), F.array(F.substring("o_orderpriority", 1, 1)))).alias("marker")).groupBy("marker").agg(F.count(F.lit(1)).alias("cases"))
    i = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("marker")).agg(F.count(F.lit(1)).alias("n"))
    return m.join(i, "marker", "left").select("marker", "cases", F.coalesce("n", F.lit(0)).alias("intents"))


@query("positional_join", "with a as (select l_orderkey as k, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as place from lineitem), b as (select o_custkey as k, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as place from orders) select k, place, l_partkey, o_orderkey from a join b using (k, place)")
def _positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey")
    b = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return records.positional(a, b, "k", ["l_linenumber", "l_partkey", "l_suppkey"], ["o_orderkey"]).select("k", "place", "l_partkey", "o_orderkey")


@query("asof_enclosing", "with p as (select event_id, user_id, epoch_us(ts) as at from events where event_type = 'purchase'), e as (select user_id, epoch_us(ts) as at, event_id as e from events where event_type <> 'purchase') select p.event_id, p.user_id, p.at, e.at as last_at, e.e as last_event from p asof left join e on p.user_id = e.user_id and p.at >= e.at")
def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    right = e.where("event_type <> 'purchase'").select("user_id", F.col("at").alias("seen"), F.col("event_id").alias("event"))
    out = records.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "at"), right, "user_id", "at", "seen", ["event"])
    return out.select("event_id", "user_id", "at", F.col("last_seen").alias("last_at"), "last_event")


@query("line_window_range_join", "with e as (select event_id, user_id, event_type, epoch_us(ts) // 1000000 as s from events) select a.event_id as error_id, b.event_id as near_id from e a join e b on a.user_id = b.user_id and abs(a.s - b.s) <= 3600 and a.event_type = 'error' and b.event_type = 'purchase'")
def _range(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    a = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("s").alias("a"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("near_id"), F.col("s").alias("b"))
    return records.near(a, b, "user_id", "a", "b", 3600).select("error_id", "near_id")


@query("semi_filter", "select c_custkey, c_mktsegment from customer where c_custkey in (select o_custkey from orders where o_orderpriority like '1%') and c_mktsegment like 'B%'")
def _semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return _table(spark, sf_dir, "customer").where(F.col("c_mktsegment").startswith("B")).join(o, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("anti_gap", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority like '1%')")
def _anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("dangling_edges", "with n as (select doc_id from labels) select distinct src, dst from (select doc_id as src, doc_id + 1 as dst from documents) where src not in (select doc_id from n) or dst not in (select doc_id from n)")
def _dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _table(spark, sf_dir, "documents").selectExpr("doc_id as src", "doc_id + 1 as dst")
    return graph.dangling(edges, _table(spark, sf_dir, "labels"), "doc_id")


_CUT = "timestamp '1998-01-01'"


@query("baseline_diff", f"with a as (select o_custkey, count(*) as n, max(o_orderstatus) as s from orders where o_orderdate < {_CUT} group by 1), b as (select o_custkey, count(*) as n, max(o_orderstatus) as s from orders where o_orderdate >= {_CUT} group by 1) select coalesce(a.o_custkey, b.o_custkey) as o_custkey, case when a.o_custkey is null then 'new' when b.o_custkey is null then 'resolved' when a.n = b.n and a.s = b.s then 'same' else 'changed' end as change from a full join b on a.o_custkey = b.o_custkey")
def _baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").groupBy("o_custkey", (F.col("o_orderdate") < F.expr("timestamp_ntz '1998-01-01'")).alias("old")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderstatus").alias("s"))
    return records.baseline(o.where("old"), o.where("not old"), "o_custkey", ["n", "s"])


_PATTERNS = {"license": "licen[sc]e", "address": "@", "symbols": "[#$%]{2}", "money": "[0-9]{4}"}


@query("pattern_theta_join", "with r(rule, p) as (values " + ", ".join(f"('{k}', '{v}')" for k, v in _PATTERNS.items()) + ") select rule, count(*) as n_docs from documents join r on regexp_matches(lower(text), p) group by rule")
def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when(F.lower("text").rlike(p), F.lit(k)) for k, p in _PATTERNS.items()]))
    return _table(spark, sf_dir, "documents").select(F.explode(hits).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n_docs"))


@query("rule_first_match", "select l_returnflag, l_linestatus, case when l_returnflag = 'R' then 'returned' when l_linestatus = 'F' then 'filled' when l_linenumber > 5 then 'late' else 'none' end as rule, count(*) as n from lineitem group by all")
def _first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.when(F.col("l_returnflag") == "R", "returned").when(F.col("l_linestatus") == "F", "filled").when(F.col("l_linenumber") > 5, "late").otherwise("none")
    return _table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", rule.alias("rule")).agg(F.count(F.lit(1)).alias("n"))


# ---- aggregations

@query("count_unset", "select coalesce(nullif(event_type, ''), 'unset') as k, count(*) as n from events group by 1")
def _unset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy(F.coalesce(F.nullif("event_type", F.lit("")), F.lit("unset")).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("multi_rollup", "select 'l_returnflag' as field, l_returnflag as value, count(*) as n from lineitem group by all union all select 'l_linestatus', l_linestatus, count(*) from lineitem group by all union all select 'l_linenumber', l_linenumber::varchar, count(*) from lineitem group by all")
def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.stacked(_table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("pivot_counts", "select o_orderpriority, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p from orders group by 1")
def _pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return out.select("o_orderpriority", *[F.coalesce(c.upper(), F.lit(0)).alias(c) for c in "fop"])


@query("family_rollup", "select p_brand, count(*) as n, list_sort(list(distinct p_type)) as kinds, count(*) filter (p_size > 25) as large from part group by 1")
def _family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("p_type")).alias("kinds"), F.count_if(F.col("p_size") > 25).alias("large"))


@query("verdict_lattice", "select l_orderkey, case when bool_or(l_returnflag = 'R') then 'R' when bool_or(l_returnflag = 'N') then 'N' else 'A' end as verdict, bool_and(l_returnflag = 'A') as all_a, count(distinct l_linestatus) > 1 as diverges, bool_and(l_returnflag in ('A', 'N')) as subset from lineitem group by 1")
def _lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        records.worst(F.col("l_returnflag"), ["R", "N", "A"]).alias("verdict"), F.bool_and(F.col("l_returnflag") == "A").alias("all_a"),
        (F.min("l_linestatus") != F.max("l_linestatus")).alias("diverges"), F.bool_and(F.col("l_returnflag").isin("A", "N")).alias("subset"),
    )


@query("catch_rate", "select coalesce(l_returnflag, 'all') as family, count(*) as mutants, count(*) filter (l_linestatus = 'F') as killed, round(100.0 * count(*) filter (l_linestatus = 'F') / count(*), 1)::DOUBLE as percent from lineitem group by rollup (l_returnflag)")
def _catch(spark: SparkSession, sf_dir: str) -> DataFrame:
    killed = F.count_if(F.col("l_linestatus") == "F")
    out = _table(spark, sf_dir, "lineitem").rollup("l_returnflag").agg(F.count(F.lit(1)).alias("mutants"), killed.alias("killed"), F.round(killed * F.lit(100.0) / F.count(F.lit(1)), 1).alias("percent"))
    return out.select(F.coalesce("l_returnflag", F.lit("all")).alias("family"), "mutants", "killed", "percent")


@query("taxonomy", "select l_returnflag, l_linestatus, l_linenumber::BIGINT as l_linenumber, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), (l_linenumber), (l_returnflag, l_linestatus))")
def _taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    out = _table(spark, sf_dir, "lineitem").groupingSets([[a], [b], [c], [a, b]], a, b, c).agg(F.count(F.lit(1)).alias("n"))
    return out.select("l_returnflag", "l_linestatus", c.cast("bigint").alias("l_linenumber"), "n")


@query("sole_blocker", "with s as (select l_orderkey, list_sort(list(distinct l_returnflag)) as c from lineitem group by 1) select c[1] as blocker, count(*) as folds from s where len(c) = 1 group by 1")
def _sole(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("blocker"), F.max("l_returnflag").alias("top"))
    return per.where("blocker = top").groupBy("blocker").agg(F.count(F.lit(1)).alias("folds"))


@query("log_bucket", "select sign(d)::BIGINT * case when abs(d) <= 0 then 0 when abs(d) <= 1 then 1 when abs(d) <= 2 then 2 when abs(d) <= 4 then 3 when abs(d) <= 8 then 4 when abs(d) <= 16 then 5 when abs(d) <= 64 then 6 else 7 end as bucket, count(*) as n from (select l_partkey - l_suppkey * 10 as d from lineitem) group by 1")
def _bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "lineitem").select(records.log_bucket(F.col("l_partkey") - F.col("l_suppkey") * 10).alias("bucket"))
    return d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("token_histogram", "select token, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as token from documents) group by 1")
def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tokens(_table(spark, sf_dir, "documents"), "text")


# ---- windows, order, sets

@query("first_wins", "select user_id, event_type, min(event_id) as event_id from events group by all")
def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.first_wins(_table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("novelty_first_seen", "with f as (select event_id, unnest(['u' || user_id, 't' || event_type || (user_id % 10)]) as feature from events), s as (select feature, min(event_id) as event_id from f group by 1) select event_id, count(*) as n_new from s group by 1")
def _novel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_id", F.array(F.concat(F.lit("u"), "user_id"), F.concat(F.lit("t"), "event_type", (F.col("user_id") % 10).cast("string"))).alias("features"))
    return records.novel(e, "event_id", "features")


@query("context_window", "with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents), c as (select *, sum(length(line)) over (partition by doc_id order by line_no rows between 1 preceding and 1 following) as context_chars from l) select doc_id, line_no::BIGINT as line_no, case when regexp_matches(line, '[0-9]{4}') then 'number' else 'license' end as rule, context_chars::BIGINT as context_chars from c where regexp_matches(line, '[0-9]{4}') or regexp_matches(line, 'icense')")
def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.mined(text.lines(_table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", {"number": "[0-9]{4}", "license": "icense"})


@query("prefix_sum", f"select {_KEYS}, sum(l_linenumber) over w::BIGINT as acc, sum(l_linenumber * l_linenumber) over w::BIGINT as nested from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows unbounded preceding)".replace("over w::BIGINT", "over w"))
def _prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber").cast("bigint")
    return ordered.summed(_table(spark, sf_dir, "lineitem").select(*KEYS), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], {"acc": n, "nested": n * n})


ORACLE_SQL["prefix_sum"] = f"select {_KEYS}, acc::BIGINT as acc, nested::BIGINT as nested from ({ORACLE_SQL['prefix_sum']})"


@query("last_definition", "select event_id, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as last_purchase from events")
def _last(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return ordered.carried(_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], bought, "last_purchase").select("event_id", "last_purchase")


@query("rank_margin", "with s as (select o_custkey, o_orderpriority as p, count(*) as n from orders group by all), r as (select *, row_number() over w as k, lead(n) over w as second from s window w as (partition by o_custkey order by n desc, p)) select o_custkey, p as top, n, coalesce(second, 0) as runner_up, 2 * n < 3 * coalesce(second, 0) as ambiguous from r where k = 1")
def _rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("n"), "o_orderpriority")
    r = s.withColumns({"k": F.row_number().over(w), "second": F.coalesce(F.lead("n").over(w), F.lit(0))}).where("k = 1")
    return r.select("o_custkey", F.col("o_orderpriority").alias("top"), "n", F.col("second").alias("runner_up"), (2 * F.col("n") < 3 * F.col("second")).alias("ambiguous"))


@query("stable_sort_topk", "select p_partkey, p_brand, p_retailprice from part order by p_retailprice desc, p_partkey limit 10")
def _topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)


@query("limit_omitted", "with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as k, count(*) over (partition by user_id) as n from events) select user_id, event_id, greatest(n - 10, 0) as omitted from r where k <= 10")
def _omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ordered.numbered(_table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], "k", "n").where("k <= 10")
    return r.select("user_id", "event_id", F.greatest(F.col("n") - 10, F.lit(0)).alias("omitted"))


@query("marker_sets", "with s as (select l_orderkey, list_sort(list(distinct l_returnflag)) as seen from lineitem group by 1), e as (select o_orderkey, case when o_orderstatus = 'F' then ['A', 'R'] else ['A', 'N'] end as want from orders) select o_orderkey, list_filter(want, lambda x: not list_contains(seen, x)) as missing, list_filter(seen, lambda x: not list_contains(want, x)) as unexpected, list_has_all(seen, want) as matched from e join s on o_orderkey = l_orderkey")
def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("seen"))
    want = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("A"), F.lit("R"))).otherwise(F.array(F.lit("A"), F.lit("N")))
    both = _table(spark, sf_dir, "orders").select("o_orderkey", want.alias("want")).join(seen, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("o_orderkey", F.array_except("want", "seen").alias("missing"), F.array_except("seen", "want").alias("unexpected"), (F.size(F.array_except("want", "seen")) == 0).alias("matched"))


# ---- text and graph

_SIGNALS = {"license": [("licen[sc]e", 3), ("copyright", 2)], "contact": [("@", 3), (r"\+[0-9]", 2)], "noise": [("[#$%&*]{3}", 1)]}


def _hits(family: str) -> str:
    return " + ".join(f"{w} * least(len(regexp_extract_all(text, '{p}')), 3)" for p, w in _SIGNALS[family])


@query("classify_weighted", f"with s as (select doc_id, list_reverse_sort([{', '.join(f'''({_hits(f)}, {-i}, '{f}')''' for i, f in enumerate(_SIGNALS))}]) as r from documents) select doc_id, case when r[1][1] >= 3 then r[1][3] else 'unknown' end as family, r[1][1]::BIGINT as score, r[2][1]::BIGINT as runner_up, 2 * r[1][1] < 3 * r[2][1] as ambiguous from s")
def _classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.classify(_table(spark, sf_dir, "documents"), "doc_id", "text", _SIGNALS)


_HINTED = "list_reverse_sort([" + ", ".join("(" + _hits(f).replace("text,", "said,") + f" + case when source like '%{f}%' then 100 else 0 end, {-i}, '{f}')" for i, f in enumerate(_SIGNALS)) + "])"


@query("classify_hinted", f"with d as (select doc_id, coalesce(source, '') as source, regexp_replace(text, '#[^\n]*', ' ', 'g') as said from documents), s as (select doc_id, {_HINTED} as r from d) select doc_id, case when r[1][1] >= 3 then r[1][3] else 'unknown' end as family, r[1][1]::BIGINT as score, r[2][1]::BIGINT as runner_up, 2 * r[1][1] < 3 * r[2][1] as ambiguous from s")
def _classify_hinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with comments blanked, and a family that the source's name has before all others."""
    return text.classify(_table(spark, sf_dir, "documents"), "doc_id", "text", _SIGNALS, comments="#[^\n]*", hint="source")


@query("decline_bucket", "select case when text like '%&&&%' then 'symbols' when text like '% | %' then 'table' when regexp_matches(text, '[A-Z]{6}') then 'capitals' when length(text) < 200 then 'short' else 'none' end as bucket, count(*) as n from documents group by 1")
def _decline(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    bucket = F.when(F.contains(t, F.lit("&&&")), "symbols").when(F.contains(t, F.lit(" | ")), "table").when(t.rlike("[A-Z]{6}"), "capitals").when(F.length(t) < 200, "short").otherwise("none")
    return _table(spark, sf_dir, "documents").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_EDGES = "select distinct l_suppkey as src, l_partkey as dst from lineitem"


@query("reachability", f"with recursive e as ({_EDGES}), reach(node, hops) using key (node) as (select 0::BIGINT, 0::BIGINT union select e.dst, min(r.hops) + 1 from reach r join e on e.src = r.node where not exists (select 1 from recurring.reach x where x.node = e.dst) group by e.dst) select node, hops from reach where node is not null")
def _reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From supplier 0 over all rows as edges, cycles and loops as they are; a part's number is that of a supplier, too."""
    edges = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return graphs.reachable(edges, spark.range(1).select(F.col("id").alias("node")))
