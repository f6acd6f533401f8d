"""Queries over memory contracts, bytes, initializers, lane packing and propositional contracts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import memory, verify
from .registry import _table, counted_sql, drawn, drawn_sql, places, query

for _name, _contracts in (("words", memory.WORDS), ("paths", memory.PATHS), ("order", memory.ORDER)):

    def _run(spark: SparkSession, sf_dir: str, contracts: list = _contracts) -> DataFrame:
        return memory.verdicts(memory.model(spark, verify.counted(places(spark, sf_dir, memory.ROWS), memory.ROWS)), contracts)

    query(f"memory_{_name}", memory.verdicts_sql(_contracts, counted_sql(memory.ROWS)))(_run)


_SPANS = "l_linenumber + 1 as dead, l_suppkey % 6 - 2 as off, l_partkey % 10 as size"


@query("memory_bytes", f"with t as (select dead, off, size, count(*) as n from (select {_SPANS} from lineitem) group by all) select dead::BIGINT as dead, off, size, n, list_bool_and(list_transform(range(0, dead), lambda b: b >= off and b < off + size)) as covered, case when off <= 0 and off + size >= dead then 'proved' else 'refuted' end as status, len(list_filter(range(0, dead), lambda b: b < off or b >= off + size))::BIGINT as surviving from t")
def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store kills another if its bytes cover all of the other's: by the interval, and byte by byte. The shapes of stores are those of rows."""
    t = _table(spark, sf_dir, "lineitem").selectExpr(*[x.replace("l_linenumber + 1", "l_linenumber + 1L") for x in _SPANS.split(", ")]).groupBy("dead", "off", "size").agg(F.count(F.lit(1)).alias("n"))
    left = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("dead") - 1), lambda b: (b < F.col("off")) | (b >= F.col("off") + F.col("size")))
    status = F.when((F.col("off") <= 0) & (F.col("off") + F.col("size") >= F.col("dead")), "proved").otherwise("refuted")
    return t.select("dead", "off", "size", "n", (F.size(left) == 0).alias("covered"), status.alias("status"), F.size(left).cast("bigint").alias("surviving"))


@query("memory_expression", "with d as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, [l_partkey & 255, l_suppkey & 255, l_orderkey & 255, 0] as m, l_linenumber % 4 as a, l_suppkey % 4 as b from lineitem), s as (select *, list_transform(m, lambda v, i: case when i - 1 = a then (l_orderkey * 7) & 255 else v end) as n from d) select l_orderkey, l_linenumber, l_partkey, l_suppkey, n as memory, n[b + 1] as loaded, m[b + 1] as before from s")
def _expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's memory of four cells, a store to it and a load from it."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    d = _table(spark, sf_dir, "lineitem").selectExpr(*keys, "array(l_partkey & 255, l_suppkey & 255, l_orderkey & 255, 0L) as m", "l_linenumber % 4 as a", "l_suppkey % 4 as b")
    s = d.withColumn("memory", F.expr(memory.SPARK.put.format(m="m", a="a", x="(l_orderkey * 7) & 255")))
    return s.select(*keys, "memory", F.expr(memory.SPARK.get.format(m="memory", a="b")).alias("loaded"), F.expr(memory.SPARK.get.format(m="m", a="b")).alias("before"))


@query("memory_bytes_of_words", "with d as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey * 40503) & 4294967295 as w, l_suppkey % 4 as off, l_linenumber > 5 as bad from lineitem), b as (select *, list_transform(range(0, 8), lambda i: case when i >= off and i < off + 4 then (w >> (8 * (i - off))) & 255 else 0 end) as bytes, list_transform(range(0, 8), lambda i: bad and i >= off and i < off + 4) as poison from d) select l_orderkey, l_linenumber, l_partkey, l_suppkey, (bytes[3] + bytes[4] * 256)::BIGINT as half, (poison[3] or poison[4]) as half_poison from b")
def _little(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word stored as little-endian bytes at an offset, with a poison map, and half a word loaded from the middle."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    d = _table(spark, sf_dir, "lineitem").selectExpr(*keys, "(l_partkey * 40503) & 4294967295 as w", "l_suppkey % 4 as off", "l_linenumber > 5 as bad")
    inside = lambda i: (i >= F.col("off")) & (i < F.col("off") + 4)
    places = F.sequence(F.lit(0), F.lit(7))
    part = lambda i: F.expr("0L") if i is None else F.call_function("shiftright", F.col("w"), (8 * (i - F.col("off"))).cast("int")).bitwiseAND(F.lit(255))
    b = d.select(*keys, F.transform(places, lambda i: F.when(inside(i), part(i)).otherwise(F.lit(0))).alias("bytes"), F.transform(places, lambda i: F.col("bad") & inside(i)).alias("poison"))
    return b.select(*keys, (F.col("bytes")[2] + F.col("bytes")[3] * 256).cast("bigint").alias("half"), (F.col("poison")[2] | F.col("poison")[3]).alias("half_poison"))


_ACCESS = "case when l_returnflag = 'R' then 'load' else 'store' end as access, l_suppkey % 50 = 7 as outside"


@query("global_initializers", f"with a as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, {_ACCESS} from lineitem), s as (select *, count(*) filter (access = 'store') over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows unbounded preceding) as stores from a) select l_orderkey, count(*) filter (access = 'load' and stores = 0) as bare_loads, case when bool_or(outside) or count(*) filter (access = 'load' and stores = 0) > 0 then 'refuted' else 'proved' end as status from s group by l_orderkey")
def _initializers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An initializer may change if nothing sees it: no load before the first store, no reader from outside. An order's lines are the accesses to a global."""
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    t = _table(spark, sf_dir, "lineitem").selectExpr("*", *[x.strip() for x in _ACCESS.rsplit(", ", 1)]).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), "access"))).alias("accesses"), F.bool_or("outside").alias("outside"))
    start = F.struct(F.lit(False).alias("stored"), F.lit(0).cast("bigint").alias("bare"))
    seen = F.aggregate("accesses", start, lambda s, a: F.struct((s.stored | (a.access == "store")).alias("stored"), (s.bare + F.when((a.access == "load") & ~s.stored, 1).otherwise(0)).cast("bigint").alias("bare")))
    return t.select("l_orderkey", seen.bare.alias("bare_loads"), F.when(F.col("outside") | (seen.bare > 0), "refuted").otherwise("proved").alias("status"))


@query("lane_packs", "with t as (select distinct l_partkey % 256 as p, l_suppkey % 256 as s from lineitem), v as (select p, s, list_transform(range(0, 4), lambda i: (p >> (2 * i)) & 3) as pack, list_transform(range(0, 4), lambda i: (s >> (2 * i)) & 3) as ext from t) select p, s, list_bool_and(list_transform(range(1, 5), lambda i: pack[ext[i] + 1] = i - 1)) as lines_up, case when list_bool_and(list_transform(range(1, 5), lambda i: pack[ext[i] + 1] = i - 1)) then 'proved' else 'refuted' end as status from v")
def _packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes packed and extracted line up if pack[ext[i]] = i for every lane. Both maps are cut from keys, two bits a lane."""
    lanes = lambda c: F.array(*[F.expr(f"cast(shiftright({c}, {2 * i}) & 3 as int)") for i in range(4)])
    t = _table(spark, sf_dir, "lineitem").selectExpr("l_partkey % 256 as p", "l_suppkey % 256 as s").distinct().select("p", "s", lanes("p").alias("pack"), lanes("s").alias("ext"))
    good = F.forall(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("pack")[F.col("ext")[i]] == i)
    return t.select("p", "s", good.alias("lines_up"), F.when(good, "proved").otherwise("refuted").alias("status"))


# Propositional contracts, as premises and goal over the facts a to d.
FACTS = {
    "dead-instruction": ("a and b", "a and b"), "dead-instruction-live-use": ("b", "a and b"), "dead-instruction-side-effect": ("a", "a and b"),
    "dead-slot": ("not a or b", "not (a and not b)"), "dead-slot-escapes": ("a", "b"), "hoist-guaranteed": ("a", "a or b"), "hoist-speculatable": ("b", "a or b"), "hoist-trapping": ("not a and not b", "a or b"),
    "merge-condition": ("true", "(case when a then b else c end) = ((a and b) or (not a and c))"), "merge-condition-swapped": ("true", "(case when a then b else c end) = ((a and c) or (not a and b))"), "impossible": ("a and not a", "b"),
}
_TABLE = f"select (i & 1) = 1 as a, (i & 2) = 2 as b, (i & 4) = 4 as c from {drawn_sql(8)}"


@query("contract_tables", f"with d as ({_TABLE}) " + " union all ".join(f"select '{n}' as contract, count(*) filter ({p}) as n_premises, count(*) filter (({p}) and not ({g})) as violations, case when count(*) filter ({p}) = 0 then 'vacuous' when count(*) filter (({p}) and not ({g})) > 0 then 'refuted' else 'proved' end as status from d" for n, (p, g) in FACTS.items()))
def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = drawn(spark, sf_dir, 8).selectExpr("(id & 1) = 1 as a", "(id & 2) = 2 as b", "(id & 4) = 4 as c")
    rows = F.array(*[F.struct(F.lit(n).alias("contract"), F.expr(p).alias("p"), F.expr(f"({p}) and not ({g})").alias("bad")) for n, (p, g) in FACTS.items()])
    out = d.select(F.inline(rows)).groupBy("contract").agg(F.count_if("p").alias("n_premises"), F.count_if("bad").alias("violations"))
    return out.withColumn("status", F.when(F.col("n_premises") == 0, "vacuous").when(F.col("violations") > 0, "refuted").otherwise("proved"))


@query("hoist_invariance", f"with g as (select i & 7 as x0, (i >> 3) & 7 as x1, (i >> 6) & 7 as k from {drawn_sql(512)}) select 'invariant' as contract, count(*) as n_rows, count(*) filter (((x0 + k) & 7) <> ((x0 + k) & 7)) as violations from g union all select 'variant', count(*), count(*) filter (((x0 + k) & 7) <> ((x1 + k) & 7)) from g")
def _invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operation moved before a loop: its operand is the same there, or that of another turn. The second copy of an operand went through text."""
    g = drawn(spark, sf_dir, 512).selectExpr("id & 7 as x0", "shiftright(id, 3) & 7 as x1", "shiftright(id, 6) & 7 as k").selectExpr("*", "cast(cast(x0 as string) as bigint) as same")
    rows = F.array(*[F.struct(F.lit(n).alias("contract"), F.expr(f"((x0 + k) & 7) <> (({x} + k) & 7)").alias("bad")) for n, x in (("invariant", "same"), ("variant", "x1"))])
    return g.select(F.inline(rows)).groupBy("contract").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("bad").alias("violations"))
