"""Queries over verdicts, registries, plans, budgets, graphs and fixed batteries: joins that compare or choose, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.words import DUCKDB
from .operators import graphs, ordered
from .plans import verify
from .registry import _table, drawn, drawn_sql, query, sampled, whole, whole_sql

_KEYS4 = "l_linenumber, l_partkey, l_suppkey"


def _n():  # noqa: ANN202
    return F.count(F.lit(1))


def _values(rows: list[tuple]) -> str:
    """Rows as VALUES of SQL."""
    def put(x: object) -> str:
        return "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else "[" + ", ".join(put(y) for y in x) + "]" if isinstance(x, list) else "'" + str(x).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(put, r)) + ")" for r in rows)


# ---- comparisons of verdicts

@query("verdict_agreement", f"with v as (select l_orderkey, arg_min(l_returnflag, ({_KEYS4})) as one, arg_max(l_returnflag, ({_KEYS4})) as two from lineitem group by 1) select l_orderkey, one, two, one = two as agree from v")
def _agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two judges, each with a table of verdicts: the first and the last line of an order."""
    rows = _table(spark, sf_dir, "lineitem").withColumn("at", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    one = rows.groupBy("l_orderkey").agg(F.min_by("l_returnflag", "at").alias("one"))
    two = rows.groupBy("l_orderkey").agg(F.max_by("l_returnflag", "at").alias("two"))
    return one.join(two, "l_orderkey", "full_outer").withColumn("agree", F.col("one").eqNullSafe(F.col("two")))


@query("emitted_vs_recomputed", "with r as (select l_orderkey, case when bool_and(l_linestatus = 'F') then 'F' when bool_and(l_linestatus = 'O') then 'O' else 'P' end as again from lineitem group by 1) select coalesce(o_orderkey, l_orderkey) as orderkey, o_orderstatus as emitted, again as recomputed, case when o_orderkey is null then 'not-emitted' when l_orderkey is null then 'no-evidence' when o_orderstatus = again then 'match' else 'mismatch' end as result from orders full join r on o_orderkey = l_orderkey")
def _recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_linestatus")
    again = F.when(F.bool_and(s == "F"), "F").when(F.bool_and(s == "O"), "O").otherwise("P")
    r = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(again.alias("recomputed"))
    both = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("emitted")).join(r, F.col("o_orderkey") == F.col("l_orderkey"), "full_outer")
    result = F.when(F.col("o_orderkey").isNull(), "not-emitted").when(F.col("l_orderkey").isNull(), "no-evidence").when(F.col("emitted").eqNullSafe(F.col("recomputed")), "match").otherwise("mismatch")
    return both.select(F.coalesce("o_orderkey", "l_orderkey").alias("orderkey"), "emitted", "recomputed", result.alias("result"))


_SMALL = [verify.Rule(r.name, r.before, r.after) for r in (*verify.LIFTED, *verify.NEGATIVES) if all(not isinstance(x, int) or x < 16 for t in (r.before, r.after) for x in (t if isinstance(t, tuple) else (t,)))]


def _grid(w: int) -> str:
    return f"select i & {2**w - 1} as x, (i >> {w}) & {2**w - 1} as y from {drawn_sql(2 ** (2 * w))}"


@query("verdict_reconcile", f"with a as ({verify.verdicts_sql(whole_sql(4), _SMALL, 4, met=True)}), b as ({verify.verdicts_sql(whole_sql(8), _SMALL, 8, met=True)}) select rule, a.status as narrow, b.status as wide, a.violations_met as narrow_met, b.violations_met as wide_met, (a.status = 'refuted') = (b.status = 'refuted') and (a.status = 'vacuous') = (b.status = 'vacuous') as agree from a join b using (rule)")
def _reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules enumerated at two widths; they have to agree."""
    a, b = (verify.verdicts(whole(spark, sf_dir, w), _SMALL, w, met=True).select("rule", F.col("status").alias(n), F.col("violations_met").alias(f"{n}_met")) for w, n in ((4, "narrow"), (8, "wide")))
    same = lambda x: (F.col("narrow") == x) == (F.col("wide") == x)
    return a.join(b, "rule").select("rule", "narrow", "wide", "narrow_met", "wide_met", (same("refuted") & same("vacuous")).alias("agree"))


# ---- fixed batteries

# Signed sample pairs, and edge values by their distance from the ends.
SAMPLES = [(-3, -3), (-3, -1), (-1, 0), (0, 0), (0, 1), (1, 0), (1, 1), (2, 3), (3, 2), (7, 1)]


def edge_values(width: int) -> list[int]:
    """0 to 3, the two greatest, the sign bit and the greatest positive number."""
    return [0, 1, 2, 3, 2**width - 1, 2**width - 2, 2 ** (width - 1), 2 ** (width - 1) - 1]


def _battery_sql(width: int, count: int = 4096) -> str:
    """Edge values for both inputs, then a tail of mixed numbers that rows of lineitem fall on."""
    from .functions import seeds

    m = 2**width - 1
    tail = lambda k, d: f"(({seeds.mixed(f'((i * 2 + {k}) & 4294967295)', d)}) & {m})"
    return f"select i, list_extract({edge_values(width)}, i + 1)::BIGINT as x, list_extract({edge_values(width)}, i + 1)::BIGINT as y from range(8) t(i) union all select i, {tail(0, DUCKDB)} as x, {tail(1, DUCKDB)} as y from {drawn_sql(count)} where i >= 8"


def battery(spark: SparkSession, sf_dir: str, width: int, count: int = 4096) -> DataFrame:
    """i, x, y: the diagonal of edge values, then mixed numbers below ``count`` that rows of lineitem fall on."""
    from .functions import seeds

    m = 2**width - 1
    edges = spark.createDataFrame(list(enumerate(edge_values(width))), "i bigint, x bigint").withColumn("y", F.col("x"))
    tail = drawn(spark, sf_dir, count).where("id >= 8").selectExpr("id as i", *[f"({seeds.mixed(f'((id * 2 + {k}) & 4294967295)')}) & {m} as {n}" for k, n in ((0, "x"), (1, "y"))])
    return edges.unionByName(tail)


@query("edge_battery", f"select 8::BIGINT as width, * from ({_battery_sql(8)}) union all select 16, * from ({_battery_sql(16)})")
def _battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return battery(spark, sf_dir, 8).withColumn("width", F.lit(8).cast("bigint")).unionByName(battery(spark, sf_dir, 16).withColumn("width", F.lit(16).cast("bigint")))


_SAMPLED = [*verify.LIFTED[:3], *verify.NEGATIVES[:3], *verify.STEPS[:4]]


@query("sampled_equivalence", f"with v as ({verify.verdicts_sql(f'select x, y from ({_battery_sql(8)})', _SAMPLED, 8)}) select rule, rows_checked, violations, case when violations > 0 then 'refuted' else 'sampled-agree' end as status from v")
def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A battery proves nothing; it refutes or agrees."""
    v = verify.verdicts(battery(spark, sf_dir, 8).select("x", "y", F.lit(1).cast("bigint").alias("n")), _SAMPLED, 8)
    return v.select("rule", "rows_checked", "violations", F.when(F.col("violations") > 0, "refuted").otherwise("sampled-agree").alias("status"))


@query("sample_pairs", f"select a::BIGINT as a, b::BIGINT as b, (a + b)::BIGINT as total, (a & b)::BIGINT as common, a < b as less, count(l_orderkey) as n from (values {_values(SAMPLES)}) t(a, b) left join lineitem on l_linenumber - 4 = a and l_suppkey % 11 - 3 = b group by a, b")
def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs, and how many rows fall on each."""
    t = spark.createDataFrame(SAMPLES, "a bigint, b bigint")
    n = _table(spark, sf_dir, "lineitem").selectExpr("l_linenumber - 4L as a", "l_suppkey % 11 - 3 as b").groupBy("a", "b").agg(_n().alias("n"))
    return t.join(n, ["a", "b"], "left").selectExpr("a", "b", "a + b as total", "a & b as common", "a < b as less", "coalesce(n, 0) as n")


_SWEEP = [0, 1, 2, 3, 7, 16, 2**31 - 1, 2**31, 2**32 - 2, 2**32 - 1]
_LOOPS = {"product": ("(n * p) & 4294967295", "(n * p) & 4294967295"), "one-short": ("(n * p) & 4294967295", "((n - 1) * p) & 4294967295"), "triangle": ("((n * (n + 1)) // 2 * p) & 4294967295", "(n * p) & 4294967295")}


@query("small_first_witness", f"with g as (select n, p from {drawn_sql(13, 'n')}, (select unnest({_SWEEP}) as p)), " + "r as (" + " union all ".join(f"select '{k}' as loop, n, p, ({a}) <> ({b}) as bad from g" for k, (a, b) in _LOOPS.items()) + ") select loop, count(*) filter (bad) as violations, (min((n, p)) filter (bad))[1]::BIGINT as trips, (min((n, p)) filter (bad))[2]::BIGINT as parameter from r group by loop")
def _small_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops against closed forms over trip counts and edge values; the witness of the fewest trips, then of the smallest parameter."""
    g = drawn(spark, sf_dir, 13).select(F.col("id").alias("n"), F.explode(F.lit(_SWEEP).cast("array<bigint>")).alias("p"))
    rows = F.array(*[F.struct(F.lit(k).alias("loop"), F.expr(f"({a.replace('//', 'div')}) <> ({b.replace('//', 'div')})").alias("bad")) for k, (a, b) in _LOOPS.items()])
    r = g.select("n", "p", F.inline(rows)).groupBy("loop").agg(F.count_if("bad").alias("violations"), F.min(F.when(F.col("bad"), F.struct("n", "p"))).alias("w"))
    return r.select("loop", "violations", F.col("w.n").alias("trips"), F.col("w.p").alias("parameter"))


_RELATED = [
    verify.Rule("or-is-add-apart", ("or", "x", "y"), ("add", "x", "y"), assume="(x & y) = 0"), verify.Rule("or-is-add", ("or", "x", "y"), ("add", "x", "y")), verify.Rule("umin-by-order", ("umin", "x", "y"), "x", assume="x <= y"),
    verify.Rule("different-addresses", ("ne", "x", "y"), 1, assume="x <> y"), verify.Rule("equal-addresses", ("sub", "x", "y"), 0, assume="x = y"), verify.Rule("no-borrow", ("sub", "x", "y"), ("sub", "x", "y", "nuw"), assume="x >= y"),
]


@query("verify_relations", verify.verdicts_sql(whole_sql(8), _RELATED, 8, met=True))
def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that hold under a relation of two variables: order, inequality, masks that don't meet."""
    return verify.verdicts(whole(spark, sf_dir, 8), _RELATED, 8, met=True)


_CLEAN = [verify.Rule("uses-poison", ("mul", "x", 0), ("mul", "y", 0), assume=a) for a in ("true",)] + [verify.Rule("not-poison", ("mul", "x", 0), ("mul", "y", 0), assume="not y_poison"), verify.Rule("neither-poison", ("xor", "x", "x"), ("xor", "y", "y"), assume="not x_poison and not y_poison")]
_STATES = f"select i & 15 as x, (i >> 4) & 15 as y, ((i >> 8) & 1) = 1 as x_poison, ((i >> 9) & 1) = 1 as y_poison from {drawn_sql(1024)}"


@query("verify_not_poison", verify.verdicts_sql(_STATES, _CLEAN, 4, poison=("x", "y"), drawn=True))
def _not_poison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.verdicts(sampled(spark, sf_dir, 4, poison=("x", "y")), _CLEAN, 4, poison=("x", "y"), drawn=True)


# ---- attribution, shapes, guards

_BEFORE = {"f1": "(a + b) & 255", "f2": "(b - a) & 255", "f3": "a ^ b", "f4": "(a * 2) & 255", "f5": "(a + b) & 255"}
_AFTER = {"f1": "(b + a) & 255", "f2": "(b + 256 - a) & 255", "f3": "(a | b) - (a & b)", "f4": "(a + a) & 255", "f5": "(a + b + 1) & 255"}
_FOLDS = {"commute": ("(a + b) & 255", "(b + a) & 255"), "sub-as-add": ("(a - b) & 255", "(a + 256 - b) & 255"), "xor-split": ("a ^ b", "(a | b) - (a & b)"), "double": ("(a + a) & 255", "(a * 2) & 255")}


def _duck(e: str) -> str:
    import re

    return re.sub(r"(\w+) \^ (\w+)", r"xor(\1, \2)", e)


def _vectors_sql(items: dict[str, str], name: str) -> str:
    return " union all ".join(f"select '{k}' as {name}, {p} as swapped, list(({_duck(e)}) order by i) as v from (select i, {'x as a, y as b' if not p else 'y as a, x as b'} from b)" for k, e in items.items() for p in (0, 1))


@query("attribution_join", f"with b as ({_battery_sql(8)}), s as (select * from ({_vectors_sql(_BEFORE, 'f')}) where swapped = 0), t as (select * from ({_vectors_sql(_AFTER, 'f')}) where swapped = 0), fb as ({_vectors_sql({k: a for k, (a, _) in _FOLDS.items()}, 'fold')}), fa as ({_vectors_sql({k: c for k, (_, c) in _FOLDS.items()}, 'fold')}), o as (select * from (values {_values(list((k, i) for i, k in enumerate(_FOLDS)))}) v(fold, ord)), m as (select s.f, fb.fold, ord from s join fb on s.v = fb.v join fa on fb.fold = fa.fold and fb.swapped = fa.swapped join t on t.f = s.f and t.v = fa.v join o on o.fold = fb.fold) select f, arg_min(fold, ord) as fold from m group by f")
def _attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change of a function with the first fold that explains it under some order of the parameters: outputs over one battery are the join key."""
    b = battery(spark, sf_dir, 8)

    def vectors(items: dict[str, str], name: str) -> DataFrame:
        both = F.array(*[F.struct(F.lit(k).alias(name), F.lit(p).alias("swapped"), F.expr(f"cast({_named(e, p)} as bigint)").alias("out")) for k, e in items.items() for p in (0, 1)])
        rows = b.select("i", F.inline(both))
        return rows.groupBy(name, "swapped").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "out"))), lambda x: x.out).alias("v"))

    def _named(e: str, swapped: int) -> str:
        import re

        return re.sub(r"\b[ab]\b", lambda m: ("x", "y")[(m[0] == "b") ^ bool(swapped)], e)

    s, t = (vectors(items, "f").where("swapped = 0").select("f", F.col("v").alias(n)) for items, n in ((_BEFORE, "source"), (_AFTER, "target")))
    folds = vectors({k: a for k, (a, _) in _FOLDS.items()}, "fold").withColumnRenamed("v", "source").join(vectors({k: c for k, (_, c) in _FOLDS.items()}, "fold").withColumnRenamed("v", "target"), ["fold", "swapped"])
    order = F.array_position(F.lit(list(_FOLDS)), F.col("fold"))
    return s.join(t, "f").join(folds, ["source", "target"]).groupBy("f").agg(F.min_by("fold", order).alias("fold"))


# A tree for each row: two operations and three variables.
_TREE = "concat('(', case l_returnflag when 'A' then 'add' when 'N' then 'sub' else 'xor' end, ' ', chr(cast(97 + l_partkey % 4 as int)), ' (', case l_linestatus when 'F' then 'mul' else 'shl' end, ' ', chr(cast(97 + l_suppkey % 4 as int)), ' ', chr(cast(97 + l_linenumber % 4 as int)), '))')"


@query("shape_canonical", f"with t as (select i, s, regexp_extract_all(s, '[a-z]+|[()]') as w from (select row_number() over () as i, s from (select distinct {_TREE} as s from lineitem))), v as (select i, s, w, list_distinct_ordered as u from (select i, s, w, list_transform(list_filter(w, lambda x: len(x) = 1 and x not in ('(', ')')), lambda x: x) as n from t) q, lateral (select list(x order by p) as list_distinct_ordered from (select x, min(p) as p from (select unnest(n) as x, generate_subscripts(n, 1) as p) group by x))), c as (select i, s, array_to_string(list_transform(w, lambda x: case when len(x) = 1 and x not in ('(', ')') then 'v' || list_position(u, x) else x end), ' ') as canonical from v) select canonical, count(*) as n, string_agg(s, ';' order by s) as trees from c group by 1")
def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees that are equal up to the names of variables: names become their order of appearance, and the text is the key."""
    t = _table(spark, sf_dir, "lineitem").select(F.expr(_TREE).alias("s")).distinct().withColumn("w", F.regexp_extract_all("s", F.lit("[a-z]+|[()]"), F.lit(0)))
    variable = lambda x: x.rlike("^[a-z]$")
    t = t.withColumn("u", F.array_distinct(F.filter("w", variable)))
    canonical = F.array_join(F.transform("w", lambda x: F.when(variable(x), F.concat(F.lit("v"), F.array_position("u", x).cast("string"))).otherwise(x)), " ")
    return t.select("s", canonical.alias("canonical")).groupBy("canonical").agg(_n().alias("n"), F.array_join(F.sort_array(F.collect_list("s")), ";").alias("trees"))


_GUARDS = {"x<128": "x < 128", "y>0": "y > 0", "x<y": "x < y", "x=0": "x = 0", "y<128": "y < 128"}
_BAD = "((x >= 128) <> (y >= 128))"  # signed and unsigned order differ


@query("guard_excludes", f"with c as (select l_orderkey & 255 as x, l_partkey & 255 as y from lineitem), b as (select * from c where {_BAD}) " + " union all ".join(f"select '{n}' as guard, count(*) as counterexamples, count(*) filter ({g}) as passing, count(*) filter ({g}) = 0 as usable from b" for n, g in _GUARDS.items()))
def _excludes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guard is usable if it excludes every counterexample: one pass over them for all guards."""
    bad = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey & 255 as x", "l_partkey & 255 as y").where(_BAD)
    sums = bad.agg(_n().alias("c"), *[F.count_if(F.expr(g)).alias(f"p{i}") for i, g in enumerate(_GUARDS.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("guard"), F.col("c").alias("counterexamples"), F.col(f"p{i}").alias("passing"), (F.col(f"p{i}") == 0).alias("usable")) for i, n in enumerate(_GUARDS)])
    return sums.select(F.inline(rows))


# Clauses of source text as facts: pattern, kind; the subject is the first group, the value the second, if there is one.
CLAUSES = [
    (r"isPowerOfTwo\((\w+)\)", "power-of-two"), (r"MaskedValueIsZero\((\w+), (\d+)\)", "known-bits"), (r"isKnownNonZero\((\w+)\)", "not-eq"), (r"isKnownNonNegative\((\w+)\)", "nonnegative"), (r"\((\w+) & (\d+)\) == 0", "known-bits"),
    (r"(\w+) != (\d+)", "not-eq"), (r"(\w+)->hasOneUse\(\)", "one-use"),
]
_CLAUSE = "case l_linenumber % 7 when 0 then concat('isPowerOfTwo(v', l_partkey % 5, ')') when 1 then concat('MaskedValueIsZero(v', l_partkey % 5, ', ', l_suppkey & 15, ')') when 2 then concat('isKnownNonZero(v', l_partkey % 5, ')') when 3 then concat('(v', l_partkey % 5, ' & ', l_suppkey & 15, ') == 0') when 4 then concat('v', l_partkey % 5, ' != ', l_suppkey & 3) when 5 then concat('v', l_partkey % 5, '->hasOneUse()') else 'unrelated' end"


@query("guard_text_facts", f"with c as (select {_CLAUSE} as clause from lineitem), f as (select clause, " + "case " + " ".join(f"when regexp_matches(clause, '{p}') then {i}" for i, (p, _) in enumerate(CLAUSES)) + " else -1 end as k from c), r as (select case k " + " ".join(f"when {i} then '{kind}'" for i, (_, kind) in enumerate(CLAUSES)) + " else 'unknown' end as kind, case k " + " ".join(f"when {i} then regexp_extract(clause, '{p}', 1)" for i, (p, _) in enumerate(CLAUSES)) + " else '' end as subject, case k " + " ".join(f"when {i} then try_cast(regexp_extract(clause, '{p}', 2) as bigint)" for i, (p, _) in enumerate(CLAUSES) if r"(\d+)" in p) + " end as value from f) select kind, subject, value, count(*) as n from r group by all")
def _text_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognisers tried in order; a clause that none knows is unknown."""
    c = _table(spark, sf_dir, "lineitem").select(F.expr(_CLAUSE).alias("clause"))
    fact = F.struct(F.lit("unknown").alias("kind"), F.lit("").alias("subject"), F.lit(None).cast("bigint").alias("value"))
    for p, kind in reversed(CLAUSES):
        value = F.regexp_extract("clause", p, 2).try_cast("bigint") if r"(\d+)" in p else F.lit(None).cast("bigint")
        fact = F.when(F.col("clause").rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("clause", p, 1).alias("subject"), value.alias("value"))).otherwise(fact)
    return c.select(fact.alias("f")).groupBy("f.kind", "f.subject", "f.value").agg(_n().alias("n"))


# Kinds of guards in the published order, each with its effect on a proof; the texts that show them are ours.
GUARD_CATALOG = [
    ("known-nonzero", "assumes-subject-nonzero", "isKnownNonZero"),
    ("guaranteed-not-poison", "assumes-subject-not-poison", "isGuaranteedNotToBePoison"),
    ("known-positive", "assumes-subject-positive", "isKnownPositive"),
    ("known-nonnegative", "assumes-subject-nonnegative", "isKnownNonNegative"),
    ("one-use", "structural-precondition-no-smt-effect", "hasOneUse"),
    ("masked-value-is-zero", "assumes-subject-known-zero-mask", "MaskedValueIsZero|& [0-9]+\\) == 0"),
    ("known-power-of-two", "assumes-subject-power-of-two", "isPowerOfTwo"),
    ("no-poison-generating-flags", "uses-unflagged-op-semantics", "dropPoisonGeneratingFlags"),
    ("profitability", "evidence-only-no-smt-effect", "isProfitable"),
    ("known-nonequal", "assumes-subjects-distinct", " != "),
    ("unknown", "unmodeled", "^unrelated$"),
]


@query("guard_catalog", f"with c as (select {_CLAUSE} as clause from lineitem), g as (select * from (values {_values(GUARD_CATALOG)}) t(kind, effect, pattern)), h as (select kind, count(*) as n from c join g on regexp_matches(clause, pattern) group by 1) select g.kind, effect, coalesce(n, 0) as n from g left join h on g.kind = h.kind")
def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of guard is found: patterns are tested in one pass, then the counts meet the catalogue."""
    hits = F.array_compact(F.array(*[F.when(F.col("clause").rlike(p), F.lit(k)) for k, _, p in GUARD_CATALOG]))
    n = _table(spark, sf_dir, "lineitem").select(F.expr(_CLAUSE).alias("clause")).select(F.explode(hits).alias("kind")).groupBy("kind").agg(_n().alias("n"))
    g = spark.createDataFrame([x[:2] for x in GUARD_CATALOG], "kind string, effect string")
    return g.join(n, "kind", "left").select("kind", "effect", F.coalesce("n", F.lit(0)).alias("n"))


# ---- matrices, gaps, top counts, sets

@query("matrix_grid", "with n as (select 8 << (l_linenumber % 4) as w, 2 << (l_suppkey % 4)::INT as l, count(*) as n from lineitem where l_partkey % 3 = 0 and l_suppkey % 5 > 0 group by 1, 2) select a.w::BIGINT as width, b.l::BIGINT as lanes, (a.w * b.l)::BIGINT as bits, coalesce(n, 0) as n from (select unnest([8, 16, 32, 64]) as w) a cross join (select unnest([2, 4, 8, 16]) as l) b left join n on n.w = a.w and n.l = b.l")
def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spark.range(1).select(F.explode(F.lit([8, 16, 32, 64]).cast("array<bigint>")).alias("width"))
    grid = one.select("width", F.explode(F.lit([2, 4, 8, 16]).cast("array<bigint>")).alias("lanes")).withColumn("bits", F.col("width") * F.col("lanes"))
    found = _table(spark, sf_dir, "lineitem").where("l_partkey % 3 = 0 and l_suppkey % 5 > 0").selectExpr("shiftleft(8L, l_linenumber % 4) as width", "shiftleft(2L, cast(l_suppkey % 4 as int)) as lanes").groupBy("width", "lanes").agg(_n().alias("n"))
    return grid.join(found, ["width", "lanes"], "left").select("width", "lanes", "bits", F.coalesce("n", F.lit(0)).alias("n"))


@query("pass_loop_matrix", "with p as (select distinct l_returnflag as pass from lineitem), l as (select unnest(range(1, 9)) as loop), c as (select l_returnflag as pass, l_linenumber as loop, count(*) as n, count(*) filter (l_linestatus = 'F') as positive from lineitem group by 1, 2), m as (select p.pass, l.loop, coalesce(n, 0) as n, coalesce(positive, 0) as positive from p cross join l left join c on c.pass = p.pass and c.loop = l.loop) select coalesce(pass, 'all') as pass, loop::BIGINT as loop, sum(n)::BIGINT as n, sum(positive)::BIGINT as positive, (case when sum(n) = 0 then 0 else round(100.0 * sum(positive) / sum(n), 1) end)::DOUBLE as rate from m group by grouping sets ((pass, loop), (pass), ())")
def _pass_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pass with every loop, cells without cases as well, their sums by pass and in all, and the headline rate."""
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("pass"), F.col("l_linenumber").cast("bigint").alias("loop"), "l_linestatus")
    c = rows.groupBy("pass", "loop").agg(_n().alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("positive"))
    cells = rows.select("pass").distinct().select("pass", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(8).cast("bigint"))).alias("loop"))
    m = cells.join(c, ["pass", "loop"], "left").na.fill(0, ["n", "positive"])
    out = m.groupingSets([[F.col("pass"), F.col("loop")], [F.col("pass")], []], "pass", "loop").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"))
    rate = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.round(F.col("positive") * F.lit(100.0) / F.col("n"), 1))
    return out.select(F.coalesce("pass", F.lit("all")).alias("pass"), "loop", "n", "positive", rate.alias("rate"))


_GAPS = {"no-label": "quality is null", "toxic-unlabelled": "toxic is null", "short": "n_chars < 200", "no-source": "source is null", "low-quality": "quality = 0"}


@query("coverage_gaps", "with d as (select lang, source, n_chars, quality, toxic from documents left join labels using (doc_id)), g as (" + " union all ".join(f"select lang, '{n}' as gap, count(*) filter ({c}) as n, count(*) as total from d group by lang" for n, c in _GAPS.items()) + ") select * from g")
def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    sums = d.groupBy("lang").agg(_n().alias("total"), *[F.count_if(F.expr(c)).alias(f"g{i}") for i, c in enumerate(_GAPS.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("gap"), F.col(f"g{i}").alias("n")) for i, n in enumerate(_GAPS)])
    return sums.select("lang", "total", F.inline(rows)).select("lang", "gap", "n", "total")


@query("top_counts", "with w as (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents), c as (select word, count(*) as n from w group by 1) select word, n from c order by n desc, word limit 3")
def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(_n().alias("n")).orderBy(F.desc("n"), "word").limit(3)


@query("first_matching_line", "with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents) select doc_id, min(line_no)::BIGINT as line_no, arg_min(length(line), line_no)::BIGINT as n_chars from l where line like '%icense%' or regexp_matches(line, '[0-9]{3}') group by 1")
def _first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).where(F.contains("line", F.lit("icense")) | F.col("line").rlike("[0-9]{3}"))
    return lines.groupBy("doc_id").agg((F.min("at") + 1).cast("bigint").alias("line_no"), F.min_by(F.length("line"), "at").cast("bigint").alias("n_chars"))


@query("covered_state", "select k, count(*) as seen_in from (select distinct o_custkey as k, 'orders' as s from orders union select distinct c_custkey, 'customer' from customer union select distinct user_id, 'events' from events) group by 1")
def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of what several runs have covered, and by how many."""
    sides = [_table(spark, sf_dir, t).select(F.col(c).alias("k"), F.lit(t).alias("s")) for t, c in (("orders", "o_custkey"), ("customer", "c_custkey"), ("events", "user_id"))]
    return sides[0].unionByName(sides[1]).unionByName(sides[2]).distinct().groupBy("k").agg(_n().alias("seen_in"))


# ---- registries, plans, promotion, triage, budgets

_RULES = [("R", "F", None, "returned-filled"), ("R", None, None, "returned"), (None, "O", 7, "late-open"), (None, "O", None, "open"), ("A", None, None, "accepted"), (None, None, None, "other")]


@query("rule_table_match", f"with r as (select row_number() over () as ord, * from (values {_values(_RULES)}) t(flag, status, line, rule)), k as (select l_returnflag, l_linestatus, l_linenumber, count(*) as n from lineitem group by all) select l_returnflag, l_linestatus, l_linenumber::BIGINT as l_linenumber, arg_min(rule, ord) as rule, any_value(n) as n from k join r on (flag is null or flag = l_returnflag) and (status is null or status = l_linestatus) and (line is null or line = l_linenumber) group by l_returnflag, l_linestatus, l_linenumber")
def _rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of rules over three fields, the first that matches: distinct keys meet the few rules, once with each set of stated fields, by equality."""
    rules = [(i, *r) for i, r in enumerate(_RULES)]
    k = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").cast("bigint").alias("line")).agg(_n().alias("n"))
    met = None
    for stated in sorted({tuple(x is not None for x in r[1:4]) for r in rules}):
        names = [c for c, s in zip(("flag", "status", "line"), stated) if s]
        some = spark.createDataFrame([r for r in rules if tuple(x is not None for x in r[1:4]) == stated], "ord bigint, flag string, status string, line bigint, rule string").select("ord", "rule", *names)
        part = (k.join(some, names) if names else k.withColumns({"ord": F.lit(len(rules) - 1).cast("bigint"), "rule": F.lit(rules[-1][-1])})).select("flag", "status", "line", "n", "ord", "rule")
        met = part if met is None else met.unionByName(part)
    best = met.groupBy("flag", "status", "line").agg(F.min_by("rule", "ord").alias("rule"), F.max("n").alias("n"))
    return best.select(F.col("flag").alias("l_returnflag"), F.col("status").alias("l_linestatus"), F.col("line").alias("l_linenumber"), "rule", "n")


_SETS = [("small-promo", [("kind", "PROMO"), ("size", "small")]), ("any-economy", [("kind", "ECONOMY")]), ("large-dear", [("size", "large"), ("price", "dear")]), ("dear-standard", [("price", "dear"), ("kind", "STANDARD")])]
_FACTS_SQL = "select p_partkey, p_type as kind, case when p_size <= 10 then 'small' when p_size > 40 then 'large' else 'medium' end as size, case when p_retailprice > 910 then 'dear' else 'cheap' end as price from part"


@query("match_set_join", f"with c as ({_FACTS_SQL}), f as (select p_partkey, 'kind' as k, kind as v from c union all select p_partkey, 'size', size from c union all select p_partkey, 'price', price from c), m as (select * from (values {_values([(s, k, v, len(ps)) for s, ps in _SETS for k, v in ps])}) t(name, k, v, need)) select p_partkey, name from f join m using (k, v) group by p_partkey, name, need having count(*) = need")
def _match_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of predicates, all of which have to hold: facts meet predicates by equality, and as many as a set has must meet."""
    size, price = F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") > 40, "large").otherwise("medium"), F.when(F.col("p_retailprice") > 910, "dear").otherwise("cheap")
    facts = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (("kind", F.col("p_type")), ("size", size), ("price", price))])
    f = _table(spark, sf_dir, "part").select("p_partkey", F.inline(facts))
    m = spark.createDataFrame([(s, k, v, len(ps)) for s, ps in _SETS for k, v in ps], "name string, k string, v string, need int")
    return f.join(m, ["k", "v"]).groupBy("p_partkey", "name").agg(_n().alias("met"), F.max("need").alias("need")).where("met = need").select("p_partkey", "name")


_PLANS = [("en", "mine", "text"), ("en", "lift", "rules"), ("de", "mine", "text"), ("fr", "sample", "runner"), ("es", "prove", "solver"), ("en", "prove", "solver")]
_TOOLS = ["text", "rules"]


@query("plan_expansion", f"with f as (select lang as family, count(*) as n from documents group by 1), p as (select * from (values {_values(_PLANS)}) t(family, strategy, needs)) select f.family, n, strategy, case when strategy is null then 'no-plan' when list_contains({_TOOLS!r}, needs) then 'feasible' else 'missing ' || needs end as reason from f left join p on f.family = p.family")
def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("family")).agg(_n().alias("n"))
    p = spark.createDataFrame(_PLANS, "family string, strategy string, needs string")
    reason = F.when(F.col("strategy").isNull(), "no-plan").when(F.col("needs").isin(_TOOLS), "feasible").otherwise(F.concat(F.lit("missing "), "needs"))
    return f.join(p, "family", "left").select("family", "n", "strategy", reason.alias("reason"))


_TEMPLATES = [("identity", "(?op ?x 0)"), ("self", "(?op ?x ?x)"), ("commute", "(?op ?x ?y)")]
_FILLERS = "case l_returnflag when 'A' then 'add' when 'N' then 'mul' else 'xor' end as op, chr(cast(97 + l_partkey % 5 as int)) as x, case when l_suppkey % 7 > 0 then chr(cast(97 + l_suppkey % 7 as int)) end as y"


@query("template_instances", f"with b as (select distinct {_FILLERS} from lineitem), t as (select * from (values {_values(_TEMPLATES)}) t(rule, template)), f as (select rule, replace(replace(replace(template, '?op', op), '?x', x), '?y', coalesce(y, '?y')) as text from t, b) select distinct rule, text, (length(text) - length(replace(text, '?', '')))::BIGINT as open_holes from f")
def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates with their holes filled from rows' bindings, one after the other by a fold; a hole without a binding stays open."""
    b = _table(spark, sf_dir, "lineitem").select(F.expr(f"struct({_FILLERS})").alias("b")).select("b.*").distinct()
    every = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(t).alias("template")) for r, t in _TEMPLATES]))
    holes = F.array(*[F.struct(F.lit(f"?{n}").alias("hole"), F.col(n).alias("filler")) for n in ("op", "x", "y")])
    text = F.aggregate("holes", F.col("t.template"), lambda s, h: F.when(h.filler.isNull(), s).otherwise(F.replace(s, h.hole, h.filler)))
    out = b.select(holes.alias("holes"), every.alias("t")).select("t.rule", text.alias("text")).distinct()
    return out.select("rule", "text", F.regexp_count("text", F.lit(r"\?")).cast("bigint").alias("open_holes"))


@query("golden_digest", "select o_orderkey, sha256('{\"custkey\":' || o_custkey || ',\"priority\":\"' || o_orderpriority || '\",\"status\":\"' || o_orderstatus || '\"}') as digest from orders")
def _digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a record in a normal form: its fields sorted by name, as JSON."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("custkey"))
    return o.select("o_orderkey", F.sha2(F.to_json(F.struct(*sorted(c for c in o.columns if c != "o_orderkey"))), 256).alias("digest"))


@query("candidate_promotion", "with c as (select o_custkey as marker, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as k, o_orderstatus from orders), e as (select o_custkey as marker, bool_or(o_orderpriority like '1%') as backed from orders group by 1), r as (select c_custkey as marker, c_acctbal > 5000 as fixed from customer where c_acctbal > 0) select c.marker, o_orderkey, case when k > 1 then 'skipped-duplicate' when not backed then 'evidence-blocked' when fixed then 'already-present' when fixed is not null then 'replaced' else 'added' end as decision from c join e on e.marker = c.marker left join r on r.marker = c.marker")
def _promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate of each marker against what is registered: what is fixed stays, other entries are replaced, what lacks evidence waits."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("marker"), "o_orderkey", "o_orderpriority")
    first = o.groupBy("marker").agg(F.min("o_orderkey").alias("first"), F.bool_or(F.col("o_orderpriority").startswith("1")).alias("backed"))
    r = _table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("marker"), (F.col("c_acctbal") > 5000).alias("fixed"))
    both = o.join(first.join(r, "marker", "left"), "marker")
    decision = F.when(F.col("o_orderkey") > F.col("first"), "skipped-duplicate").when(~F.col("backed"), "evidence-blocked").when(F.col("fixed"), "already-present").when(F.col("fixed").isNotNull(), "replaced").otherwise("added")
    return both.select("marker", "o_orderkey", decision.alias("decision"))


# Fixed values: (transform, is it what the registry says?, before, after, what running the optimizer said).
_TRIAGE = [("mul-zero", False, ("mul", "x", 0), "x", None), ("udiv-shift", True, ("udiv", "x", "y"), ("lshr", "x", "y"), None), ("add-one", True, ("add", "x", 1), "x", None), ("add-one-run", True, ("add", "x", 1), "x", "refuted"), ("add-zero", True, ("add", "x", 0), "x", None), ("sub-commute", True, ("sub", "x", "y"), ("sub", "y", "x"), None)]
_ATOMS = {"x=y": "x = y", "y=0": "y = 0", "x<16": "x < 16", "y=1": "y = 1"}


def _triage_rules() -> list:
    return [verify.Rule(f"{n}|{g or 'always'}", b, a, assume=_ATOMS.get(g, "true")) for n, _, b, a, _ in _TRIAGE for g in ("", *_ATOMS)]


@query("triage", f"with v as ({verify.verdicts_sql(_grid(4), _triage_rules(), 4, drawn=True)}), s as (select split_part(rule, '|', 1) as name, bool_or(split_part(rule, '|', 2) = 'always' and violations = 0) as sound, bool_or(split_part(rule, '|', 2) <> 'always' and violations = 0 and rows_checked > 0) as guarded from v group by 1), t as (select * from (values {_values([(n, f, r) for n, f, _, _, r in _TRIAGE])}) t(name, faithful, run)) select name, case when not faithful then 'lifter-issue' when sound then 'not-a-bug' when guarded then 'missing-precondition' when run = 'refuted' then 'real' else 'suspected' end as verdict from t join s using (name)")
def _triage_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a refuted transform is: ill read, sound after all, sound under some guard, refuted by a run as well, or suspected."""
    v = verify.verdicts(sampled(spark, sf_dir, 4), _triage_rules(), 4, drawn=True)
    name, guard = F.split_part("rule", F.lit("|"), F.lit(1)), F.split_part("rule", F.lit("|"), F.lit(2))
    good = F.col("violations") == 0
    s = v.groupBy(name.alias("name")).agg(F.bool_or((guard == "always") & good).alias("sound"), F.bool_or((guard != "always") & good & (F.col("rows_checked") > 0)).alias("guarded"))
    t = spark.createDataFrame([(n, f, r) for n, f, _, _, r in _TRIAGE], "name string, faithful boolean, run string")
    verdict = F.when(~F.col("faithful"), "lifter-issue").when(F.col("sound"), "not-a-bug").when(F.col("guarded"), "missing-precondition").when(F.col("run") == "refuted", "real").otherwise("suspected")
    return t.join(s, "name").select("name", verdict.alias("verdict"))


_BUDGETS = [("orders", "max", 1000), ("open", "max", 5), ("planned", "min", 1), ("value", "max", 10**12), ("customers", "min", 10**6)]
_METRICS = {"orders": "count(*)", "open": "count(*) filter (where o_orderstatus = 'O')", "planned": "count(*) filter (where o_orderstatus = 'P')", "value": "cast(sum(cast(o_totalprice as bigint)) as bigint)", "customers": "count(distinct o_custkey)"}


@query("budget_violations", "with m as (" + " union all ".join(f"select '{k}' as metric, ({v})::BIGINT as amount from orders" for k, v in _METRICS.items()).replace("cast(o_totalprice as bigint)", "floor(o_totalprice)::BIGINT") + f"), b as (select * from (values {_values(_BUDGETS)}) t(metric, side, budget)) select metric, side, budget::BIGINT as budget, amount from m join b using (metric) where (side = 'max' and amount > budget) or (side = 'min' and amount < budget)")
def _budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    sums = o.selectExpr(*[f"cast({v.replace('cast(o_totalprice as bigint)', 'floor(o_totalprice)')} as bigint) as {k}" for k, v in _METRICS.items()])
    m = sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("amount")) for k in _METRICS])))
    b = spark.createDataFrame(_BUDGETS, "metric string, side string, budget bigint")
    return m.join(b, "metric").where("(side = 'max' and amount > budget) or (side = 'min' and amount < budget)").select("metric", "side", "budget", "amount")


# ---- graphs

# A graph for each order: its lines lead from one of eight nodes to another; the root is node 0.
_DOM_SQL = "recursive e as (select distinct l_orderkey as graph, (l_linenumber - 1)::BIGINT as src, (l_partkey % 8)::BIGINT as dst from lineitem), r as (select distinct graph, 0::BIGINT as node from e union select e.graph, e.dst from r join e on e.graph = r.graph and e.src = r.node), a as (select graph, node as without, 0::BIGINT as node from r where node <> 0 union select a.graph, a.without, e.dst from a join e on e.graph = a.graph and e.src = a.node and e.dst <> a.without), dom as (select r.graph, r.node, d.node as dominator from r join r d on r.graph = d.graph where not exists (select 1 from a where a.graph = r.graph and a.without = d.node and a.node = r.node))"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = _lines(spark, sf_dir).distinct()
    return edges, edges.select("graph", F.lit(0).cast("bigint").alias("node")).distinct()


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, some repeated."""
    return _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as graph", "l_linenumber - 1L as src", "l_partkey % 8 as dst")


def _rooted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same graphs for operators that repeated edges don't disturb: no shuffle of the edges comes first."""
    edges = _lines(spark, sf_dir)
    return edges, edges.select("graph", F.lit(0).cast("bigint").alias("node")).distinct()


@query("dominators", f"with {_DOM_SQL} select graph, node, string_agg(dominator::VARCHAR, ',' order by dominator) as dominators from dom group by graph, node")
def _dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.dominators(*_rooted(spark, sf_dir)).select("graph", "node", F.array_join(F.col("dominators").cast("array<string>"), ",").alias("dominators"))


@query("loop_headers", f"with {_DOM_SQL} select distinct e.graph, e.dst as header, e.src as tail from e join dom on dom.graph = e.graph and dom.node = e.src and dom.dominator = e.dst")
def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.headers(*_rooted(spark, sf_dir))


@query("path_check", "with e as (select distinct l_orderkey as graph, l_linenumber - 1 as src, l_partkey % 8 as dst from lineitem), p as (select l_orderkey as path, list_prepend(0, list(l_partkey % 8 order by l_linenumber, l_partkey, l_suppkey)) as nodes from lineitem group by 1), s as (select path, unnest(nodes[1:len(nodes)-1]) as src, unnest(nodes[2:]) as dst from p) select p.path, count(s.src) as n_steps, bool_and(s.src is null or e.src is not null) as exists from p left join s using (path) left join e on e.graph = p.path and e.src = s.src and e.dst = s.dst group by p.path")
def _path_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each order's lines lead, one after the other, as a path through its graph."""
    line = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    p = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("graph")).agg(F.transform(line, lambda x: x.l_partkey % 8).alias("nodes"))
    p = p.select("graph", F.col("graph").alias("path"), F.concat(F.array(F.lit(0).cast("bigint")), "nodes").alias("nodes"))
    return graphs.paths_exist(p, _graph(spark, sf_dir)[0])


@query("program_graph", "with e as (select event_id, user_id, event_type, row_number() over w as place, lead(event_id) over w as next, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as def from events window w as (partition by user_id order by ts, event_id)) select event_id as src, next as dst, 'flow' as kind from e where next is not null union all select def, event_id, 'use' from e where event_type = 'click' and def is not null")
def _program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of flow from each step to the next, and from the last definition before it to each use."""
    by, order = ["user_id"], ["ts", "event_id"]
    e = ordered.followed(_table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "ts"), by, order, F.col("event_id"), "next")
    e = ordered.carried(e, by, order, F.when(F.col("event_type") == "purchase", F.col("event_id")), "def", own=False)
    flow = F.when(F.col("next").isNotNull(), F.struct(F.col("event_id").alias("src"), F.col("next").alias("dst"), F.lit("flow").alias("kind")))
    use = F.when((F.col("event_type") == "click") & F.col("def").isNotNull(), F.struct(F.col("def").alias("src"), F.col("event_id").alias("dst"), F.lit("use").alias("kind")))
    return e.select(F.inline(F.array_compact(F.array(flow, use))))


@query("graph_contract", f"with {_DOM_SQL}, n as (select graph, src as node from e union select graph, dst from e), f as (select n.graph, count(*) filter (r.node is null) as lost, (select count(*) from e x where x.graph = n.graph and x.src = x.dst) as self_loops, (select count(*) from e x where x.graph = n.graph and x.dst = 0) as into_root from n left join r on r.graph = n.graph and r.node = n.node group by n.graph) select graph, concat_ws(',', case when lost > 0 then 'unreachable' end, case when self_loops > 0 then 'self-loop' end, case when into_root > 0 then 'root-entered' end) as failed, case when lost + self_loops + into_root = 0 then 'ok' else 'failed' end as status from f")
def _contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of each graph, which of them failed, and the status that follows."""
    edges, roots = _graph(spark, sf_dir)
    nodes = edges.select("graph", F.explode(F.array("src", "dst")).alias("node")).distinct()
    lost = nodes.join(graphs.reachable(edges, roots, ("graph",)).select("graph", "node", F.lit(True).alias("seen")), ["graph", "node"], "left").groupBy("graph").agg(F.count_if(F.col("seen").isNull()).alias("lost"))
    other = edges.groupBy("graph").agg(F.count_if(F.col("src") == F.col("dst")).alias("self_loops"), F.count_if(F.col("dst") == 0).alias("into_root"))
    failed = F.concat_ws(",", *[F.when(F.col(c) > 0, n) for c, n in (("lost", "unreachable"), ("self_loops", "self-loop"), ("into_root", "root-entered"))])
    return lost.join(other, "graph").select("graph", failed.alias("failed"), F.when(failed == "", "ok").otherwise("failed").alias("status"))
