"""Queries that search or iterate: mutants of rules, preconditions, invariants, pairings, loops, reduction and campaigns, with their SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import checkpointed
from .functions.words import DUCKDB, SPARK
from .operators import configs, probes
from .plans import verify
from .plans.expression import compiled, variables
from .probing import _SHAPED_SQL, _shaped
from .registry import _table, drawn, drawn_sql, query, sampled
from .trails import _grid, _values

# ---- rules: mutants, freeze, free variables, preconditions

_MUTANTS = [verify.Rule(f"{r.name}+1", r.before, ("add", r.after, 1)) for r in verify.IDENTITIES] + [verify.Rule(f"{r.name}|swap", (r.before[0], r.before[2], r.before[1]), r.after) for r in verify.IDENTITIES if isinstance(r.before, tuple) and r.before[0] in ("sub", "shl", "lshr")]


@query("verify_mutants", verify.verdicts_sql(_grid(8), _MUTANTS, 8, drawn=True))
def _mutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known rules, each made wrong: a checker without teeth would let one pass. Swapped operands of a rule over equal ones change nothing."""
    return verify.verdicts(sampled(spark, sf_dir, 8), _MUTANTS, 8, drawn=True)


_FREEZE = [
    verify.Rule("freeze-same", ("freeze", "x", "c"), ("freeze", "x", "c")), verify.Rule("freeze-dropped", ("freeze", "x", "c"), "x"), verify.Rule("freeze-added", "x", ("freeze", "x", "c")),
    verify.Rule("freeze-twice", ("sub", ("freeze", "x", "c"), ("freeze", "x", "c")), 0), verify.Rule("freeze-through", ("freeze", ("xor", "x", 5), "c"), ("xor", ("freeze", "x", "c"), 5)),
]
_FROZEN = f"select i & 15 as x, (i >> 4) & 15 as c, ((i >> 8) & 1) = 1 as x_poison from {drawn_sql(512)}"


@query("verify_freeze", verify.verdicts_sql(_FROZEN, _FREEZE, 4, ("x", "c"), ("x",), True))
def _freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen values as choices of their own; both sides have the same choice, so a freeze that moves through an operation is refuted."""
    return verify.verdicts(sampled(spark, sf_dir, 4, ("x", "c"), ("x",)), _FREEZE, 4, ("x", "c"), ("x",), True)


_ALL_RULES = [*verify.IDENTITIES, *verify.NEGATIVES, *verify.STEPS, *verify.CALLS]


@query("undef_risk", f"select rule, len(list_filter(after, lambda v: not list_contains(before, v))) > 0 as risky, case when len(list_filter(after, lambda v: not list_contains(before, v))) > 0 then (select count(*) from lineitem where l_linenumber % 7 = 0) else 0 end as n_rows from (values {_values([(f'{i}:{r.name}', variables(r.before), variables(r.after)) for i, r in enumerate(_ALL_RULES)]).replace('[]', '[]::VARCHAR[]')}) t(rule, before, after)")
def _risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule whose result has a variable that its source hasn't can't be judged where that variable may be undefined: here in every row of the seventh line."""
    unsure = _table(spark, sf_dir, "lineitem").agg(F.count_if(F.col("l_linenumber") % 7 == 0).alias("n"))
    risky = F.size(F.array_except("after", "before")) > 0
    rows = F.explode(F.array(*[F.struct(F.lit(f"{i}:{r.name}").alias("rule"), F.lit(variables(r.before)).cast("array<string>").alias("before"), F.lit(variables(r.after)).cast("array<string>").alias("after")) for i, r in enumerate(_ALL_RULES)]))
    return unsure.select("n", rows.alias("r")).select("n", "r.*").select("rule", risky.alias("risky"), F.when(risky, F.col("n")).otherwise(0).alias("n_rows"))


_ATOMS = {"x<128": "x < 128", "y<128": "y < 128", "y>0": "y > 0", "pow2(y)": "y > 0 and (y & (y - 1)) = 0", "x>=y": "x >= y", "apart": "(x & y) = 0"}
_WANTED = {"sdiv-udiv": (("sdiv", "x", "y"), ("udiv", "x", "y")), "urem-mask": (("urem", "x", "y"), ("and", "x", ("sub", "y", 1))), "or-add": (("or", "x", "y"), ("add", "x", "y")), "sub-usub-sat": (("sub", "x", "y"), ("usub_sat", "x", "y")), "never": (("add", "x", 1), "x"), "always": (("xor", "x", "x"), 0)}
_CHOICES = [()] + [c for k in (1, 2) for c in combinations(_ATOMS, k)]


def _fails(name: str, dialect: object) -> str:
    a, b = (compiled(t, 8, dialect).value for t in _WANTED[name])
    return f"(({a}) <> ({b}))"


def _holds(atoms: tuple) -> str:
    return " and ".join(f"({_ATOMS[a]})" for a in atoms) or "true"


_PRE_SQL = f"with g as ({_grid(8)}), r as (" + " union all ".join(f"select '{n}' as rule, {i} as ord, {len(c)} as atoms, '{'&'.join(c)}' as guard, count(*) filter ({_holds(c)}) as covered, count(*) filter ({_holds(c)} and {_fails(n, DUCKDB)}) as leaks from g" for n in _WANTED for i, c in enumerate(_CHOICES)) + ") select rule, coalesce(arg_min(guard, ord) filter (covered > 0 and leaks = 0), 'none') as guard, coalesce(min(atoms) filter (covered > 0 and leaks = 0), -1)::BIGINT as atoms from r group by rule"


@query("precondition_synthesis", _PRE_SQL)
def _preconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each transform the first working set of atoms, fewest first; sets that hold nowhere don't count. One pass over the domain for each transform."""
    g, out = sampled(spark, sf_dir, 8), None
    for name in _WANTED:
        rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.expr(_holds(c)).alias("on")) for i, c in enumerate(_CHOICES)])
        seen = g.select(F.expr(_fails(name, SPARK)).alias("bad"), F.inline(rows)).where("on").groupBy("ord").agg(F.count_if("bad").alias("leaks")).where("leaks = 0")
        part = seen.agg(F.min("ord").alias("ord")).withColumn("rule", F.lit(name))
        out = part if out is None else out.unionByName(part)
    named = F.lit(["&".join(c) for c in _CHOICES])
    sizes = F.lit([len(c) for c in _CHOICES])
    return out.select("rule", F.coalesce(F.get(named, F.col("ord")), F.lit("none")).alias("guard"), F.coalesce(F.get(sizes, F.col("ord")), F.lit(-1)).cast("bigint").alias("atoms"))


# ---- invariants of loops: candidates meet the values of a loop, one aggregate for all

_LOOPS = {"count-up": "7 + 3 * i", "count-down": "5 - 2 * i", "square": "i * i", "constant": "4"}


@query("affine_templates", "with v as (" + " union all ".join(f"select '{n}' as loop, i, {e} as v from {drawn_sql(12)}" for n, e in _LOOPS.items()) + "), c as (select o - 8 as start, s - 8 as stride from range(17) a(o), range(17) b(s)), f as (select loop, start, stride from v, c group by all having bool_and(v = start + i * stride)) select l.loop, f.start::BIGINT as start, f.stride::BIGINT as stride from (select distinct loop from v) l left join f on f.loop = l.loop")
def _affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """start + i * stride for a loop's values: a candidate is fixed by two values, so only those meet the rest."""
    v = drawn(spark, sf_dir, 12).select(F.col("id").alias("i"), F.inline(F.array(*[F.struct(F.lit(n).alias("loop"), F.expr(e.replace("i", "id")).cast("bigint").alias("v")) for n, e in _LOOPS.items()])))
    first = v.groupBy("loop").agg(F.max(F.when(F.col("i") == 0, F.col("v"))).alias("start"), F.max(F.when(F.col("i") == 1, F.col("v"))).alias("next")).withColumn("stride", F.col("next") - F.col("start"))
    good = v.join(first, "loop").groupBy("loop", "start", "stride").agg(F.bool_and(F.col("v") == F.col("start") + F.col("i") * F.col("stride")).alias("fits"))
    inside = F.col("fits") & F.col("start").between(-8, 8) & F.col("stride").between(-8, 8)
    return good.select("loop", F.when(inside, F.col("start")).alias("start"), F.when(inside, F.col("stride")).alias("stride"))


@query("coupled_synthesis", f"with g as (select i // 9 + 1 as a, i % 9 as n from {drawn_sql(45)}), v as (select a, n, a * n as s, (select coalesce(sum(a * k), 0) from range(n) r(k)) as t from g), p as (select x - 4 as p from range(9) t(x)), first as (select 's' as name, p as square, 0 as linear from v, p group by p having bool_and(s = p * a * n)), second as (select 't' as name, x.p as square, y.p as linear from v, p x, p y group by all having bool_and(2 * t = a * (x.p * n * n + y.p * n))) select name, square::BIGINT as square, linear::BIGINT as linear from first union all select name, square, linear from second")
def _coupled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s += a, then t += s: the form of s first, then that of t with it, over all starts and trips up to the degree and beyond."""
    trips = F.sequence(F.lit(1).cast("bigint"), F.greatest(F.col("n"), F.lit(1)))
    step = lambda z, _: F.struct((z.s + F.col("a")).alias("s"), (z.t + z.s).alias("t"))
    zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("t"))
    g = drawn(spark, sf_dir, 45).selectExpr("id div 9 + 1 as a", "id % 9 as n")
    v = g.select("a", "n", F.when(F.col("n") == 0, zero).otherwise(F.aggregate(trips, zero, step)).alias("z")).select("a", "n", "z.s", "z.t")
    few = F.explode(F.sequence(F.lit(-4).cast("bigint"), F.lit(4).cast("bigint")))
    first = v.withColumn("square", few).groupBy("square").agg(F.bool_and(F.expr("s = square * a * n")).alias("fits")).where("fits").select(F.lit("s").alias("name"), "square", F.lit(0).cast("bigint").alias("linear"))
    second = v.withColumn("square", few).withColumn("linear", few).groupBy("square", "linear").agg(F.bool_and(F.expr("2 * t = a * (square * n * n + linear * n)")).alias("fits")).where("fits")
    return first.unionByName(second.select(F.lit("t").alias("name"), "square", "linear"))


_PAIRS = {"product": ("i * k", "k + k * (i - 1)"), "triangle": ("i * (i + 1)", "i * i + i"), "off-by-one": ("i * k", "(i + 1) * k"), "sum-of-both": ("i * k + i", "i * (k + 1)")}


@query("relational_synthesis", f"with g as (select j // 9 as i, j % 9 as k from {drawn_sql(81, 'j')}) " + " union all ".join(f"select '{n}' as model, count(*) as points, bool_and(({a}) = ({b})) as found from g" for n, (a, b) in _PAIRS.items()))
def _relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of two loops as polynomials of degree two: equal on nine by nine points, so equal."""
    g = drawn(spark, sf_dir, 81).selectExpr("id div 9 as i", "id % 9 as k", "cast(cast(id div 9 as string) as bigint) as j", "cast(cast(id % 9 as string) as bigint) as l")
    other = lambda e: e.replace("i", "j").replace("k", "l")
    rows = F.array(*[F.struct(F.lit(n).alias("model"), F.expr(f"({a}) = ({other(b)})").alias("same")) for n, (a, b) in _PAIRS.items()])
    return g.select(F.inline(rows)).groupBy("model").agg(F.count(F.lit(1)).alias("points"), F.bool_and("same").alias("found"))


_OUTPUTS = {"a": ["i * 2", "i + 3", "i + i", "i * i * i"], "b": ["3 + i", "2 * i", "i * i", "i + i + 0"]}
_OUT_SQL = "select side, ord, list(v order by i) as v from (" + " union all ".join(f"select '{s}' as side, {k} as ord, i, {e} as v from {drawn_sql(8)}" for s, es in _OUTPUTS.items() for k, e in enumerate(es)) + ") group by 1, 2"


@query("output_pairing", f"with o as ({_OUT_SQL}), r as (select *, row_number() over (partition by side, v order by ord) as k from o) select a.ord::BIGINT as before, b.ord::BIGINT as after from (select * from r where side = 'a') a left join (select * from r where side = 'b') b on a.v = b.v and a.k = b.k")
def _pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each output takes the first unused one that equals it on all points: equal ones meet by their order among equals."""
    from pyspark.sql import Window

    rows = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(k).cast("bigint").alias("ord"), F.expr(e.replace("i", "id")).alias("v")) for s, es in _OUTPUTS.items() for k, e in enumerate(es)])
    o = drawn(spark, sf_dir, 8).select("id", F.inline(rows)).groupBy("side", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "v"))), lambda x: x.v).alias("v"))
    r = o.withColumn("k", F.row_number().over(Window.partitionBy("side", "v").orderBy("ord")))
    a, b = (r.where(F.col("side") == s).select("v", "k", F.col("ord").alias(n)) for s, n in (("a", "before"), ("b", "after")))
    return a.join(b, ["v", "k"], "left").select("before", "after")


_HOUDINI = {"x=y": "{x} = {y}", "x<=y": "{x} <= {y}", "x even": "{x} % 2 = 0", "y=0": "{y} = 0", "sum even": "({x} + {y}) % 2 = 0", "x<8": "{x} < 8"}
_NEXT = {"x": "((x + 1) & 15)", "y": "((y + 1) & 15)"}


def _atom(name: str, after: bool = False) -> str:
    return "(" + _HOUDINI[name].format(**(_NEXT if after else {"x": "x", "y": "y"})) + ")"


_HOUDINI_SQL = f"with s as (select i & 15 as x, i >> 4 as y from {drawn_sql(256)}), m as (select unnest(range({2 ** len(_HOUDINI)})) as m), " + "good as (select m from m, s group by m having bool_and(not (" + " and ".join(f"((m & {2**k}) = 0 or {_atom(n)})" for k, n in enumerate(_HOUDINI)) + ") or (" + " and ".join(f"((m & {2**k}) = 0 or {_atom(n, True)})" for k, n in enumerate(_HOUDINI)) + "))), top as (select bit_or(m) as m from good) select atom, (m & b) <> 0 as kept from top, (values " + ", ".join(f"('{n}', {2**k})" for k, n in enumerate(_HOUDINI)) + ") t(atom, b)"


@query("houdini", _HOUDINI_SQL)
def _houdini(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From all atoms that hold at the start (0, 0), those go that a step from where all others hold doesn't keep, until none goes. The SQL tries all subsets."""
    s = drawn(spark, sf_dir, 256).selectExpr("id & 15 as x", "shiftright(id, 4) as y")
    kept = list(_HOUDINI)
    while kept:
        row = s.where(" and ".join(_atom(n) for n in kept)).agg(*[F.coalesce(F.bool_and(F.expr(_atom(n, True))), F.lit(True)).alias(f"a{i}") for i, n in enumerate(kept)]).first()
        after = [n for i, n in enumerate(kept) if row[f"a{i}"]]
        if after == kept:
            break
        kept = after
    return spark.createDataFrame([(n, n in kept) for n in _HOUDINI], "atom string, kept boolean")


# ---- loops against each other

_SIM = {"same": ("s", "((a + s) & 63)", "s < 40"), "other-step": ("s", "((a + s + 1) & 63)", "s < 40"), "other-guard": ("s", "((a + s) & 63)", "s < 41")}


@query("simulation_obligations", f"with g as (select i & 63 as s, (i >> 6) & 63 as a from {drawn_sql(4096)}) " + " union all ".join(f"select '{n}' as model, 0::BIGINT as bad_init, count(*) filter ((s < 40) <> ({g})) as bad_guard, count(*) filter (s < 40 and ((a + s) & 63) <> {st}) as bad_step, 0::BIGINT as bad_result from g" for n, (_, st, g) in _SIM.items()))
def _simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loops under equality of their states: start, guard, step and result, each counted where it fails. The second loop's state went through text."""
    g = drawn(spark, sf_dir, 4096).selectExpr("id & 63 as s", "shiftright(id, 6) & 63 as a").selectExpr("*", "cast(cast(s as string) as bigint) as s2", "cast(cast(a as string) as bigint) as a2")
    two = lambda e: e.replace("s", "s2").replace("a", "a2")
    rows = F.array(*[F.struct(F.lit(n).alias("model"), F.expr("s = 0 and s2 <> 0").alias("i"), F.expr(f"(s < 40) <> ({two(gd)})").alias("g"), F.expr(f"s < 40 and ((a + s) & 63) <> {two(st)}").alias("t"), F.expr("s >= 40 and a <> a2").alias("r")) for n, (_, st, gd) in _SIM.items()])
    return g.select(F.inline(rows)).groupBy("model").agg(*[F.count_if(c).alias(n) for c, n in (("i", "bad_init"), ("g", "bad_guard"), ("t", "bad_step"), ("r", "bad_result"))])


_EXITS = {"same": (["s > 50", "a = 13"], ["a", "s"], ["s > 50", "a = 13"], ["a", "s"]), "other-result": (["s > 50", "a = 13"], ["a", "s"], ["s > 50", "a = 13"], ["a", "a"]), "fewer-exits": (["s > 50", "a = 13"], ["a", "s"], ["s > 50"], ["a"]), "other-decision": (["s > 50"], ["a"], ["s >= 50"], ["a"])}


def _exit_parts(d1: list, r1: list, d2: list, r2: list) -> tuple[str, str]:
    return " or ".join(f"(({a}) <> ({b}))" for a, b in zip(d1, d2)), " or ".join(f"(({a}) and ({x}) <> ({y}))" for a, x, y in zip(d1, r1, r2))


@query("multi_exit", f"with g as (select i & 63 as s, (i >> 6) & 63 as a from {drawn_sql(4096)}) " + " union all ".join(f"select '{n}' as model, {str(len(d1) == len(d2)).lower()} as same_exits, count(*) filter ({_exit_parts(d1, r1, d2, r2)[0]}) as bad_decisions, count(*) filter ({_exit_parts(d1, r1, d2, r2)[1]}) as bad_results from g" for n, (d1, r1, d2, r2) in _EXITS.items()))
def _multi_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops with several exits: as many of them, each decided alike, each with equal results where it is taken."""
    g = drawn(spark, sf_dir, 4096).selectExpr("id & 63 as s", "shiftright(id, 6) & 63 as a")
    rows = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(len(d1) == len(d2)).alias("same_exits"), F.expr(_exit_parts(d1, r1, d2, r2)[0]).alias("d"), F.expr(_exit_parts(d1, r1, d2, r2)[1]).alias("r")) for n, (d1, r1, d2, r2) in _EXITS.items()])
    return g.select(F.inline(rows)).groupBy("model", "same_exits").agg(F.count_if("d").alias("bad_decisions"), F.count_if("r").alias("bad_results"))


_INNER = {"before": "((a * 3 + 1) & 255)", "after": "((a + a + a + 1) & 255)", "wrong": "((a * 3 + 2) & 255)"}


def _four(e: str, start: str = "a") -> str:
    """An inner loop's effect four times."""
    out = start
    for _ in range(4):
        out = e.replace("a", f"({out})") if "a" in e else e
    return out


@query("nested_loops", "with t as (select i as a, " + ", ".join(f"{e.replace('a', 'i')} as {n}" for n, e in _INNER.items()) + f" from {drawn_sql(256)}), " + ", ".join(f"{n}_4 as (select p.a, q4.{n} as out from t p join t q2 on q2.a = p.{n} join t q3 on q3.a = q2.{n} join t q4 on q4.a = q3.{n})" for n in _INNER) + " " + " union all ".join(f"select '{n}' as inner_loop, (select count(*) from t where before <> {n}) as inner_violations, (select count(*) from before_4 x join {n}_4 y on x.a = y.a where x.out <> y.out) as outer_violations" for n in ("after", "wrong")))
def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inner loop as a table of its effect, joined once for each turn of the outer one."""
    t = drawn(spark, sf_dir, 256).selectExpr("id as a", *[f"{e.replace('a', 'id')} as {n}" for n, e in _INNER.items()])
    turned = {}
    for n in _INNER:
        run = t.select("a", F.col(n).alias("at"))
        for _ in range(3):
            run = run.join(t.select(F.col("a").alias("at"), F.col(n).alias("then")), "at").select("a", F.col("then").alias("at"))
        turned[n] = run.withColumnRenamed("at", n)
    both = turned["before"].join(turned["after"], "a").join(turned["wrong"], "a")
    inner = t.select(*[F.expr(f"before <> {n}").alias(f"i_{n}") for n in ("after", "wrong")]).agg(*[F.count_if(f"i_{n}").alias(f"i_{n}") for n in ("after", "wrong")])
    outer = both.select(*[F.expr(f"before <> {n}").alias(f"o_{n}") for n in ("after", "wrong")]).agg(*[F.count_if(f"o_{n}").alias(f"o_{n}") for n in ("after", "wrong")])
    count = lambda rows, c: rows.select(F.inline(F.array(*[F.struct(F.lit(n).alias("inner_loop"), F.col(f"{c}_{n}").alias(v)) for n, v in ((n, {"i": "inner_violations", "o": "outer_violations"}[c]) for n in ("after", "wrong"))])))
    return count(inner, "i").join(count(outer, "o"), "inner_loop")


@query("loop_rotate", f"with g as (select j // 5 as n, j % 5 as k from {drawn_sql(165, 'j')}) select n, k, (n * k) & 255 as plain, case when n > 0 then (k + (n - 1) * k) & 255 else 0 end as rotated, ((n * k) & 255) = (case when n > 0 then (k + (n - 1) * k) & 255 else 0 end) as agrees, ((n * k) & 255) = ((k + (greatest(n, 1) - 1) * k) & 255) as unguarded from g")
def _rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loop tested at its head, and the same tested at its foot behind a guard: folds over the turns. Without the guard it runs once too often for no turns."""
    g = drawn(spark, sf_dir, 165).selectExpr("id div 5 as n", "id % 5 as k")
    zero = F.lit(0).cast("bigint")
    run = lambda turns, start: F.aggregate(turns, start, lambda s, _: (s + F.col("k")).bitwiseAND(F.lit(255)))
    turns = lambda n: F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), F.greatest(n, F.lit(1)))).otherwise(F.lit([]).cast("array<bigint>"))
    foot = run(turns(F.greatest(F.col("n"), F.lit(1)) - 1), F.col("k"))
    out = g.select("n", "k", run(turns(F.col("n")), zero).alias("plain"), F.when(F.col("n") > 0, foot).otherwise(zero).alias("rotated"), foot.alias("f"))
    return out.select("n", "k", "plain", "rotated", (F.col("plain") == F.col("rotated")).alias("agrees"), (F.col("plain") == F.col("f")).alias("unguarded"))


_STEP = "((a * 5 + i) & 255)"


def _unrolled(trips: int) -> str:
    out = "x"
    for i in range(trips):
        out = _STEP.replace("a", "@").replace("i", str(i)).replace("@", f"({out})")
    return out


@query("bounded_unroll", f"with g as (select x from {drawn_sql(256, 'x')}) " + " union all ".join(f"select {t}::BIGINT as trips, count(*) as points, count(*) filter (list_reduce(list_prepend(x, range({t})), lambda a, i: {_STEP}) <> {_unrolled(t)}) as violations, count(*) filter (list_reduce(list_prepend(x, range({t})), lambda a, i: {_STEP}) <> {_unrolled(t - 1)}) as teeth from g" for t in (2, 4, 6)))
def _unroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loop of constant trips as a fold, against itself written out; one turn less is found."""
    g = drawn(spark, sf_dir, 256).withColumnRenamed("id", "x").withColumn("y", F.expr("cast(cast(x as string) as bigint)"))
    rows = F.array(*[F.struct(F.lit(t).cast("bigint").alias("trips"), F.expr(f"aggregate(sequence(0L, {t - 1}L), x, (a, i) -> {_STEP}) <> {_unrolled(t).replace('x', 'y')}").alias("bad"), F.expr(f"aggregate(sequence(0L, {t - 1}L), x, (a, i) -> {_STEP}) <> {_unrolled(t - 1).replace('x', 'y')}").alias("short")) for t in (2, 4, 6)])
    return g.select(F.inline(rows)).groupBy("trips").agg(F.count(F.lit(1)).alias("points"), F.count_if("bad").alias("violations"), F.count_if("short").alias("teeth"))


@query("observable_calls", "with c as (select l_orderkey, string_agg(l_returnflag || ':' || l_partkey, ',' order by l_linenumber, l_partkey, l_suppkey) as before, coalesce(string_agg(l_returnflag || ':' || l_partkey, ',' order by l_linenumber, l_partkey, l_suppkey) filter (l_discount > 0.005), '') as after from lineitem group by 1) select l_orderkey, before = after as same from c")
def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with effects, in their order, before and after those with a discount of nothing are taken away: sequences have to be equal."""
    call = lambda keep: F.sort_array(F.collect_list(F.when(keep, F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))))
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((call(F.lit(True)) == call(F.col("l_discount") > 0.005)).alias("same"))


# ---- configurations from constraints, reduction to a fixed point, campaigns

# A constraint of a record and the patch that it asks for; the first that a record has counts.
CONSTRAINTS = [
    ("instruction.is_dead", "true", "extra_opcode", 4), ("block.reachable", "false", "shape", 3), ("cfg.shape", "diamond", "shape", 1), ("cfg.shape", "nested-branch", "shape", 2), ("cfg.shape", "switch-like-chain", "shape", 4),
    ("memory.alloca", "promotable", "memory_shape", 1), ("memory.store_load_forward", "true", "memory_shape", 1), ("memory.store", "dead", "memory_shape", 3), ("memory.store", "overwritten", "memory_shape", 4), ("memory.load", "redundant", "memory_shape", 2),
    ("memory.alloca", "unused", "memory_shape", 5), ("loop.shape", "canonical", "loop_shape", 1), ("loop.induction", "phi", "loop_shape", 1), ("loop.trip_count", "simple", "loop_shape", 1), ("loop.invariant", "true", "loop_shape", 3),
    ("loop.body_instruction", "dead", "loop_shape", 4), ("loop.exit", "early", "loop_shape", 2), ("vector.shuffle", "identity", "vector_shape", 4), ("vector.shuffle", "splat", "vector_shape", 5), ("vector.reduction", "add-zero", "vector_shape", 7),
]
_PICK = "(o_orderkey * 31 + o_custkey) % 23"


@query("constraint_configs", f"with r as (select row_number() over () - 1 as ord, * from (values {_values(CONSTRAINTS)}) t(k, v, field, value)), c as (select o_orderkey, unnest([{_PICK}, (o_orderkey * 17) % 29]) as pick from orders), m as (select o_orderkey, arg_min(field, ord) as field, arg_min(value, ord) as value from c join r on ord = pick group by 1) select o.o_orderkey, coalesce(field, 'none') as field, coalesce(value, 0)::BIGINT as value, case when o_orderstatus = 'F' and field = 'memory_shape' then 2 when o_orderstatus = 'P' and field = 'memory_shape' then 1 else 0 end::BIGINT as store_mode from orders o left join m on m.o_orderkey = o.o_orderkey")
def _constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records' constraints meet the rules by key and value; the first rule's patch counts, and facts of the record set the store mode on top."""
    r = spark.createDataFrame([(i, *c) for i, c in enumerate(CONSTRAINTS)], "ord bigint, k string, v string, field string, value bigint")
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.explode(F.array(F.expr(_PICK), F.expr("(o_orderkey * 17) % 29"))).alias("at"))
    named = o.join(r.select(F.col("ord").alias("at"), "k", "v"), "at", "left").select("o_orderkey", "o_orderstatus", "k", "v")
    met = named.join(r, ["k", "v"], "left").groupBy("o_orderkey", "o_orderstatus").agg(F.min(F.struct("ord", "field", "value")).alias("x"), F.min(F.when(F.col("ord").isNotNull(), F.struct("ord", "field", "value"))).alias("y"))
    field = F.col("y.field")
    mode = F.when((F.col("o_orderstatus") == "F") & (field == "memory_shape"), 2).when((F.col("o_orderstatus") == "P") & (field == "memory_shape"), 1).otherwise(0)
    return met.select("o_orderkey", F.coalesce(field, F.lit("none")).alias("field"), F.coalesce("y.value", F.lit(0)).alias("value"), mode.cast("bigint").alias("store_mode"))


_TARGET = "probe.mem2reg.store-load-forward"


def _fixpoint_sql(rounds: int) -> str:
    parts, last, k = [f"c0 as (select * from ({_SHAPED_SQL}) where {probes.CLOSED[_TARGET]})"], "c0", 0
    for _ in range(rounds):
        for f in probes.REDUCED:
            k += 1
            parts.append(f"c{k} as (select * replace ({probes.smaller(f, _TARGET)} as {f}) from {last})")
            last = f"c{k}"
    return f"with {', '.join(parts)} select {', '.join(f'{f}::BIGINT as {f}' for f in configs.FIELDS)}, count(*) as n from {last} group by all"


@query("reduce_fixpoint", _fixpoint_sql(3))
def _fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of reduction until none changes a row; what is left, and of how many."""
    rows = checkpointed(_shaped(spark, sf_dir).where(probes.CLOSED[_TARGET]).groupBy(*configs.FIELDS).agg(F.count(F.lit(1)).alias("n")))
    while True:
        after = checkpointed(probes.reduced(rows, _TARGET).groupBy(*configs.FIELDS).agg(F.sum("n").alias("n")))
        if after.count() == rows.count() and rows.join(after, [*configs.FIELDS, "n"], "left_anti").isEmpty():
            return after
        rows = after


_MARKS = "list_filter([" + ", ".join(f"case when {probes.CLOSED[m]} then '{m}' end" for m in probes.MARKERS) + "], lambda x: x is not null)"


def _campaign_sql(generations: int) -> str:
    parts = [f"g0 as (select * from ({_SHAPED_SQL}) where seed < 300)", "f0 as (select min(seed) as seed, m from (select seed, unnest(" + _MARKS + ") as m from g0) group by m)"]
    for k in range(1, generations + 1):
        old = " union all ".join(f"select m from f{j}" for j in range(k))
        parts.append(f"g{k} as ({configs.mutants_sql(f'g{k - 1}', 'seed', k, DUCKDB)})")
        parts.append(f"f{k} as (select min(seed) as seed, m from (select seed, unnest({_MARKS}) as m from g{k}) where m not in ({old}) group by m)")
    return f"with {', '.join(parts)} " + " union all ".join(f"select {k}::BIGINT as generation, m as marker, seed from f{k}" for k in range(generations + 1))


@query("campaign", _campaign_sql(3))
def _campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations of mutants; a row is kept for each marker that no generation has shown and that it shows first. What was seen is a table of markers."""
    rows, seen = checkpointed(_shaped(spark, sf_dir).where("seed < 300")), None
    for k in range(4):
        if k:
            rows = checkpointed(configs.mutants(rows, "seed", k))
        found = checkpointed(probes.records(rows)).select("seed", F.explode(probes.markers()).alias("marker")).groupBy("marker").agg(F.min("seed").alias("seed"))
        found = found if seen is None else found.join(seen.select("marker"), "marker", "left_anti")
        found = checkpointed(found.select(F.lit(k).cast("bigint").alias("generation"), "marker", "seed"))
        seen = found if seen is None else seen.unionByName(found)
    return seen
