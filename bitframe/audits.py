"""Queries for audits of cases, evidence, passes and markers, and for ordered and iterative checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import audit, ordered, records
from .registry import _KEYS, KEYS, _table, query

def _n() -> Column:
    return F.count(F.lit(1))


# ---- joins

@query("pad_zip", "with a as (select o_custkey as k, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as place from orders), b as (select user_id as k, event_id, row_number() over (partition by user_id order by event_id) as place from events) select coalesce(a.k, b.k) as k, coalesce(a.place, b.place) as place, coalesce(o_orderkey, -1) as o_orderkey, coalesce(event_id, -1) as event_id from a full join b on a.k = b.k and a.place = b.place")
def _pad_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    b = _table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id")
    return audit.pad_zip(a, b, "k", ["o_orderkey"], ["event_id"], -1)


_SETS = {"small": "p_size <= 10", "steel": "p_type like '%STEEL%'", "dear": "p_retailprice > 1500"}


@query("match_sets", "select p_partkey, array_to_string(list_filter([" + ", ".join(f"case when {p} then '{k}' end" for k, p in _SETS.items()) + "], lambda x: x is not null), ',') as rules from part")
def _match_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(",", *[F.when(F.expr(p), F.lit(k)) for k, p in _SETS.items()]).alias("rules"))


@query("module_diff", "with a as (select o_custkey as k, count(*) as n from orders where o_orderstatus = 'F' group by 1), b as (select o_custkey as k, count(*) as n from orders where o_orderstatus = 'O' group by 1) select coalesce(a.k, b.k) as k, case when b.k is null then 'removed' when a.k is null then 'added' when a.n = b.n then 'same' else 'changed' end as change from a full join b on a.k = b.k")
def _module_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _table(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')").groupBy(F.col("o_custkey").alias("k"))
    both = per.agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "O").alias("b"))
    return both.select("k", F.expr("case when b = 0 then 'removed' when a = 0 then 'added' when a = b then 'same' else 'changed' end").alias("change"))


# ---- aggregations

@query("explode_counts", "select word, count(*) as n from (select unnest(string_split(p_type, ' ')) as word from part) group by 1")
def _explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("word")).groupBy("word").agg(_n().alias("n"))


@query("weighted_count", "select p_brand, sum(p_size)::BIGINT as n from part group by 1")
def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_size").alias("n"))


@query("cond_counts", "select count(*) filter (o_orderstatus = 'F') as positive, count(*) filter (o_orderstatus = 'O') as negative, count(*) filter (o_orderstatus = 'P') as planned, count(*) filter (o_orderstatus not in ('F', 'O', 'P')) as error from orders")
def _conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return _table(spark, sf_dir, "orders").agg(F.count_if(s == "F").alias("positive"), F.count_if(s == "O").alias("negative"), F.count_if(s == "P").alias("planned"), F.count_if(~s.isin("F", "O", "P")).alias("error"))


@query("compose_all", "select l_orderkey, case when bool_and(l_linestatus = 'F') then 'steps' when o_orderstatus = 'P' then 'direct' else 'open' end as verdict from lineitem join orders on l_orderkey = o_orderkey group by l_orderkey, o_orderstatus")
def _compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_linestatus") == "F").alias("all"))
    both = steps.join(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", F.when(F.col("all"), "steps").when(F.col("o_orderstatus") == "P", "direct").otherwise("open").alias("verdict"))


@query("divergence", "select l_orderkey, count(distinct l_returnflag) as outcomes from lineitem group by 1 having count(distinct l_returnflag) > 1")
def _divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.diverging(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query("evidence_cascade", "select l_orderkey, case when bool_or(l_returnflag = 'R' and l_linestatus = 'F') then 'replayed-bad' when count(*) filter (l_returnflag <> 'N') = 0 then 'not-run' when bool_and(l_returnflag = 'A') filter (l_returnflag <> 'N') then 'only-unsupported' when count(*) > 3 then 'covered' else 'partial' end as status from lineitem group by 1")
def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    ran = F.col("l_returnflag") != "N"
    facts = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("bad"), F.count_if(ran).alias("ran"),
        F.bool_and(F.when(ran, F.col("l_returnflag") == "A")).alias("unsupported"), _n().alias("n"),
    )
    status = F.when(F.col("bad"), "replayed-bad").when(F.col("ran") == 0, "not-run").when(F.col("unsupported"), "only-unsupported").when(F.col("n") > 3, "covered").otherwise("partial")
    return facts.select("l_orderkey", status.alias("status"))


@query("coverage_pct", "select p_brand, case when count(*) = 0 then 0.0 else round(100.0 * count(*) filter (p_size > 25) / count(*), 1) end::DOUBLE as percent from part group by 1")
def _percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").groupBy("p_brand").agg(audit.percent(F.col("p_size") > 25).alias("percent"))


@query("dossier", "select split_part(p_brand, '#', 2) as pass, count(*) filter (p_size <= 15) as proved, count(*) filter (p_size between 16 and 35) as declined, count(*) filter (p_size > 35) as refuted from part group by 1")
def _dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return _table(spark, sf_dir, "part").groupBy(F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("pass")).agg(F.count_if(size <= 15).alias("proved"), F.count_if(size.between(16, 35)).alias("declined"), F.count_if(size > 35).alias("refuted"))


@query("width_uniform", "select l_partkey, case when count(distinct l_returnflag) = 1 then min(l_returnflag) else 'width-specific' end as verdict from lineitem group by 1")
def _uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.when(F.min("l_returnflag") == F.max("l_returnflag"), F.min("l_returnflag")).otherwise("width-specific").alias("verdict"))


@query("histogram_delta", "select lang, word, (count(*) filter (source_new) - count(*) filter (not source_new))::BIGINT as delta from (select lang, doc_id % 2 = 1 as source_new, unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents) group by 1, 2 having count(*) filter (source_new) <> count(*) filter (not source_new)")
def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "documents").select("lang", (F.col("doc_id") % 2 == 1).alias("new"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return audit.delta(words, ["lang", "word"], "new")


@query("distinct_declines", "select distinct regexp_extract(text, '[A-Z]{4,}') as token from documents where regexp_matches(text, '[A-Z]{4,}')")
def _declines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.regexp_extract("text", "[A-Z]{4,}", 0).alias("token")).where("token <> ''").distinct()


# ---- order, windows, sets

@query("rule_per_group", "select l_orderkey, l_linenumber, arg_min(l_partkey, (l_extendedprice, l_partkey, l_suppkey)) as l_partkey from lineitem group by 1, 2")
def _per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    return records.first_wins(rows, ["l_orderkey", "l_linenumber"], ["l_extendedprice", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("ordered_dedup", "select user_id, string_agg(event_type, ',' order by first) as kinds from (select user_id, event_type, min(event_id) as first from events group by 1, 2) group by 1")
def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.first_order(_table(spark, sf_dir, "events"), "user_id", "event_type", "event_id").select("user_id", F.array_join("event_type", ",").alias("kinds"))


_RANK = ["purchase", "signup", "view", "click", "error"]


@query("argmax_stable", "with s as (select user_id, event_type, count(*) as n, list_position(" + repr(_RANK) + ", event_type) as r from events group by 1, 2) select user_id, arg_max(event_type, (n, -r)) as top from s group by 1")
def _argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(_n().alias("n"))
    return s.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", (-F.array_position(F.lit(_RANK), F.col("event_type"))).alias("r"))).alias("top"))


@query("nested_prefix_sum", f"with s as (select {_KEYS}, sum(l_linenumber) over w as s from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows unbounded preceding)) select {_KEYS}, s::BIGINT as s, (sum(s) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows unbounded preceding))::BIGINT as t from s")
def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of all sums so far of x is (place + 1) * sum(x) - sum(place * x)."""
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    rows = ordered.numbered(_table(spark, sf_dir, "lineitem").select(*KEYS), ["l_orderkey"], order)
    n = F.col("l_linenumber").cast("bigint")
    both = ordered.summed(rows, ["l_orderkey"], [*order, "place"], {"s": n, "placed": n * F.col("place")})
    return both.select(*KEYS, "s", ((F.col("place") + 1) * F.col("s") - F.col("placed")).alias("t"))


_BRANCHES = ["x % 3 = 0", "x % 5 = 0", "x % 2 = 0", "x > 128"]


@query("first_true_branch", "with i as (select l_orderkey & 255 as x from lineitem), b as (select case " + " ".join(f"when {g} then {i}" for i, g in enumerate(_BRANCHES)) + " else -1 end::BIGINT as branch from i) select branch, count(*) as n from b group by 1")
def _branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey").bitwiseAND(255)).alias("x"))
    return x.select(audit.first_true(_BRANCHES).alias("branch")).groupBy("branch").agg(_n().alias("n"))


@query("known_order", "with c as (select event_type, count(*) as n, list_position(['view', 'click'], event_type) as o from events group by 1) select event_type, n, row_number() over (order by coalesce(o, 99), event_type) as place from c")
def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "events").groupBy("event_type").agg(_n().alias("n"))
    return c.withColumn("place", F.row_number().over(Window.orderBy(audit.known_place(F.col("event_type"), ["view", "click"]), "event_type")).cast("bigint"))  # a row per kind


@query("priority_actions", "with a as (select o_custkey, case when count(*) filter (o_orderstatus = 'P') > 0 then 1 when count(*) > 12 then 2 end as priority from orders group by 1) select priority, o_custkey from a where priority is not null order by priority, o_custkey limit 20")
def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("open"), _n().alias("n"))
    return per.select(F.when(F.col("open") > 0, 1).when(F.col("n") > 12, 2).alias("priority"), "o_custkey").where("priority is not null").orderBy("priority", "o_custkey").limit(20)


@query("novel_filter", "select l_orderkey from lineitem group by 1 having len(list_filter(list(distinct l_returnflag || l_linestatus), lambda x: x not in ('NO', 'AF'))) > 0")
def _novel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("seen"))
    return seen.where(F.size(F.array_except("seen", F.lit(["NO", "AF"]))) > 0).select("l_orderkey")


@query("changed_fields", f"with a as (select *, lead(l_returnflag) over w as f2, lead(l_linestatus) over w as s2, lead(l_linenumber) over w as n2 from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)) select {_KEYS}, concat_ws(',', case when l_returnflag is distinct from f2 then 'l_returnflag' end, case when l_linestatus is distinct from s2 then 'l_linestatus' end) as changed from a where n2 is not null")
def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(*KEYS, "l_returnflag", "l_linestatus")
    rows = ordered.followed(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], F.struct("l_returnflag", "l_linestatus"), "then").where("then is not null")
    return rows.select(*KEYS, audit.changed(["l_returnflag", "l_linestatus"], "then").alias("changed"))


# ---- iteration and graphs

@query("toposort", "with recursive e as (select distinct l_suppkey % 20 as src, l_partkey % 20 as dst from lineitem where l_partkey % 20 > l_suppkey % 20), n as (select src as node from e union select dst from e), walk as (select node, 0 as level from n where node not in (select dst from e) union select dst, level + 1 from walk join e on src = node) select node::BIGINT as node, max(level)::BIGINT as level from walk group by 1")
def _toposort(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("src"), (F.col("l_partkey") % 20).alias("dst")).where("dst > src")
    return audit.levels(e.select("src", "dst").distinct(), 20)


@query("strength_reduction", "with g as (select l_suppkey, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) - 1 as i from lineitem) select l_suppkey, k::BIGINT as k, count(*) filter (((i * k) & 65535) <> ((i * k) % 65536)) as violations, max(i * k)::BIGINT as top from g, (select unnest([3, 5, 12, 255]) as k) group by 1, 2")
def _strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product in a loop equals the running sum of its step: each supplier's lines are the turns of a loop."""
    order = ["l_orderkey", "l_linenumber", "l_partkey"]
    steps = [3, 5, 12, 255]
    g = ordered.numbered(_table(spark, sf_dir, "lineitem").select("l_suppkey", *order), ["l_suppkey"], order)
    g = ordered.summed(g, ["l_suppkey"], [*order, "place"], {f"s{k}": F.lit(k).cast("bigint") for k in steps})
    turns = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), (F.col(f"s{k}") - k).alias("acc")) for k in steps]))
    g = g.select("l_suppkey", (F.col("place") - 1).alias("i"), turns.alias("x")).select("l_suppkey", "i", "x.*")
    return g.groupBy("l_suppkey", "k").agg(F.count_if((F.col("i") * F.col("k")).bitwiseAND(65535) != F.col("acc").bitwiseAND(65535)).alias("violations"), F.max("acc").alias("top"))


@query("mem_store_load", "select l_orderkey, a::BIGINT as address, arg_max(l_partkey, (l_linenumber, l_partkey, l_suppkey)) as value from (select *, l_suppkey % 4 as a from lineitem) group by 1, 2")
def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory after a row's stores: the last store to an address is what a load reads."""
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 4).alias("address"), "l_linenumber", "l_partkey", "l_suppkey")
    return records.last_wins(rows, ["l_orderkey", "address"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "address", F.col("l_partkey").alias("value"))


@query("mem_bytes_cover", "select (l_suppkey % 97)::BIGINT as place, count(distinct b) as bytes from (select *, unnest(range(l_partkey % 16, l_partkey % 16 + l_linenumber)) as b from lineitem) group by 1")
def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a place that stores of different lengths cover: intervals as bit masks, united by OR."""
    mask = F.expr("shiftleft(shiftleft(1L, l_linenumber) - 1, cast(l_partkey % 16 as int))")
    return _table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 97).alias("place")).agg(F.bit_count(F.bit_or(mask)).cast("bigint").alias("bytes"))
