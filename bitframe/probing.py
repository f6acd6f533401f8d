"""Queries over configurations: rows of seeds, mutants, children, abstract records, probes, markers, oracles and reduction, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import checkpointed
from .functions.words import DUCKDB
from .operators import configs, probes
from .registry import _table, query

_ALL = ", ".join(configs.FIELDS)
_ROWS_SQL = f"select i as seed, {', '.join(f'{configs.of_seed(f, chr(105), DUCKDB)} as {f}' for f in configs.FIELDS)} from (select event_id from events where event_id is not null) t(i)"


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seed for each event: its number."""
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("seed")).where("seed is not null")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each seed, written once: the mixes are long expressions that many columns use."""
    return checkpointed(configs.seeded(_seeds(spark, sf_dir), "seed"))


@query("config_rows", _ROWS_SQL)
def _config_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configs.seeded(_seeds(spark, sf_dir), "seed")


_FORCED = {f: f"case when seed % 4 = 0 then {f} else 0 end" for f in ("vector_shape", "global_shape")}  # most seeds have a vector or global shape, which hides all others
_SHAPED_SQL = f"select * replace ({', '.join(f'{e} as {f}' for f, e in _FORCED.items())}) from ({_ROWS_SQL})"


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).withColumns({f: F.expr(e).cast("bigint") for f, e in _FORCED.items()})


_RAW = {f: f"(user_id * {3 + i} - event_id * {5 + 2 * i})" for i, f in enumerate(configs.FIELDS)}


@query("config_normal_all", f"select event_id, {', '.join(f'cast({configs.normal(f, v)} as bigint) as {f}' for f, v in _RAW.items())} from events")
def _normal_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.selectExpr("event_id", *[f"cast({configs.normal(f, v)} as bigint) as {f}" for f, v in _RAW.items()])


@query("config_default", f"with c as ({_ROWS_SQL}) " + " union all ".join(f"select '{f}' as field, {v}::BIGINT as value, count(*) filter ({f} = {v}) as n from c" for f, v in configs.default().items()))
def _default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default row, and how many seeds have each of its values."""
    base = configs.default()
    sums = _rows(spark, sf_dir).agg(*[F.count_if(F.col(f) == v).alias(f) for f, v in base.items()])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).cast("bigint").alias("value"), F.col(f).alias("n")) for f, v in base.items()])))


@query("config_mutants", configs.mutants_sql(f"({_ROWS_SQL})", "seed", 1, DUCKDB))
def _mutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configs.mutants(_rows(spark, sf_dir), "seed", 1)


@query("config_children", f"with c as ({_ROWS_SQL}), p as (select seed - 1 as s2, {', '.join(f'{f} as {f}_2' for f in configs.FIELDS)} from c) select seed, {', '.join(f'{configs.crossed(f, chr(115) + chr(101) + chr(101) + chr(100), DUCKDB)} as {f}' for f in configs.FIELDS)} from c join p on seed = s2")
def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _rows(spark, sf_dir)
    p = c.select((F.col("seed") - 1).alias("seed"), *[F.col(f).alias(f"{f}_2") for f in configs.FIELDS])
    return c.join(p, "seed").selectExpr("seed", *[f"{configs.crossed(f, 'seed')} as {f}" for f in configs.FIELDS])


@query("config_text", f"with c as ({_ROWS_SQL}) select seed, sha256({' || '.join(f'''('{f}=' || {f} || chr(10))''' for f in configs.FIELDS)}) as digest from c")
def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("seed", F.sha2(configs.as_text(), 256).alias("digest"))


_PATCHES = "select * from (values " + ", ".join(f"('{m}', '{f}', {v}::BIGINT)" for m, p in probes.MARKERS.items() for f, v in configs.patched(p).items()) + ") t(marker, field, value)"


@query("marker_patches", f"with c as ({_ROWS_SQL}), p as ({_PATCHES}), n as (" + " union all ".join(f"select '{f}' as field, {f} as value, count(*) as n from c group by 2" for f in configs.FIELDS) + ") select marker, field, value, coalesce(n, 0) as n from p left join n using (field, value)")
def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches meet the default row by field: a left join, the patch's value first; n: seeds with this value."""
    patch = spark.createDataFrame([(m, f, v) for m, p in probes.MARKERS.items() for f, v in p.items()], "marker string, field string, patch bigint")
    base = spark.createDataFrame([(m, f, v) for m in probes.MARKERS for f, v in configs.default().items()], "marker string, field string, value bigint")
    asked = base.join(patch, ["marker", "field"], "left").select("marker", "field", F.coalesce("patch", "value").alias("value"))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in configs.FIELDS]))
    n = _rows(spark, sf_dir).select(pairs.alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(n, ["field", "value"], "left").select("marker", "field", "value", F.coalesce("n", F.lit(0)).alias("n"))


_MARKED_SQL = f"select *, list_filter([{', '.join(f'''case when {c} then '{m}' end''' for m, c in ((m, probes.CLOSED[m]) for m in probes.MARKERS))}], lambda x: x is not null) as markers from c"


@query("probe_markers", f"with c as ({_SHAPED_SQL}) select seed, array_to_string(markers, ',') as markers, len(markers)::BIGINT as n from ({_MARKED_SQL})")
def _probe_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = probes.records(_shaped(spark, sf_dir)).select("seed", probes.markers().alias("m"))
    return found.select("seed", F.concat_ws(",", "m").alias("markers"), F.size("m").cast("bigint").alias("n"))


@query("probe_counts", f"with c as ({_SHAPED_SQL}), m as ({_MARKED_SQL}) select marker, count(*) as n from (select unnest(markers) as marker from m) group by 1")
def _probe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.records(_shaped(spark, sf_dir)).select(F.explode(probes.markers()).alias("marker")).groupBy("marker").agg(F.count(F.lit(1)).alias("n"))


_LEN = "case when global_shape <> 0 or vector_shape <> 0 then 0 when memory_shape <> 0 then (case pointer_mode when 0 then 1 else 2 end) + (case memory_shape when 1 then (case store_mode when 0 then 2 else 3 end) when 2 then 3 when 3 then 1 when 4 then 3 else 0 end) when loop_shape <> 0 then 7 + (case loop_shape when 2 then 2 else 0 end) else (case shape when 0 then 1 when 1 then 2 when 3 then 2 else 3 end) + (case when extra_opcode <> 0 then 1 else 0 end) end"
_BLOCKS = "case when global_shape <> 0 or vector_shape <> 0 then 1 when memory_shape <> 0 then (case store_mode when 2 then 4 else 1 end) when loop_shape <> 0 then 5 else (case shape when 0 then 1 when 1 then 4 when 3 then 2 else 6 end) end"


@query("abstract_records", f"with c as ({_SHAPED_SQL}) select seed, ({_LEN})::BIGINT as n_instructions, ({_BLOCKS})::BIGINT as n_blocks from c")
def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.records(_shaped(spark, sf_dir)).select("seed", F.size("instructions").cast("bigint").alias("n_instructions"), F.size("blocks").cast("bigint").alias("n_blocks"))


@query("opcode_presence", f"with c as ({_SHAPED_SQL}) select count(*) filter (global_shape = 0 and vector_shape = 0 and memory_shape in (1, 2, 4)) as with_load, count(*) filter (global_shape = 0 and vector_shape = 0 and memory_shape = 2) as with_two_loads, count(*) filter (global_shape = 0 and vector_shape = 0 and memory_shape = 0 and loop_shape <> 0) as with_phi, count(*) filter (global_shape = 0 and vector_shape = 0 and memory_shape = 0 and loop_shape = 0 and shape = 3) as with_unreachable from c")
def _presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda name: F.size(F.filter("instructions", lambda i: i.opcode == name))
    r = probes.records(_shaped(spark, sf_dir))
    return r.agg(F.count_if(n("load") > 0).alias("with_load"), F.count_if(n("load") > 1).alias("with_two_loads"), F.count_if(n("phi") > 0).alias("with_phi"), F.count_if(F.exists("blocks", lambda b: ~b.reachable)).alias("with_unreachable"))


@query("category", f"with c as ({_SHAPED_SQL}) select seed, {probes.CATEGORY} as category, case {probes.CATEGORY} " + " ".join(f"when '{k}' then '{v}'" for k, v in probes.PIPELINES.items()) + " else 'instcombine' end as pipeline from c")
def _category(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _shaped(spark, sf_dir).select("seed", F.expr(probes.CATEGORY).alias("category"))
    named = F.create_map(*[F.lit(x) for kv in probes.PIPELINES.items() for x in kv])
    return c.select("seed", "category", F.coalesce(F.try_element_at(named, F.col("category")), F.lit("instcombine")).alias("pipeline"))


_NEEDED = ["probe.mem2reg.promotable-alloca", "probe.mem2reg.store-load-forward"]


@query("marker_preserved", f"with c as ({_SHAPED_SQL}), m as ({_MARKED_SQL}) select seed, list_has_all(markers, {_NEEDED!r}) as preserved, case when len(markers) = 0 then 'not-instrumented' when list_has_all(markers, {_NEEDED!r}) and len(markers) = {len(_NEEDED)} then 'matched' else 'mismatch' end as exact, case when len(markers) = 0 then 'not-instrumented' when list_has_all(markers, {_NEEDED!r}) then 'matched' else 'mismatch' end as with_extra from m")
def _preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, needed = probes.records(_shaped(spark, sf_dir)).select("seed", probes.markers().alias("m")), F.lit(_NEEDED)
    return found.select("seed", probes.preserved(F.col("m"), needed).alias("preserved"), probes.oracle_status(needed, F.col("m")).alias("exact"), probes.oracle_status(needed, F.col("m"), True).alias("with_extra"))


# What a generator's configuration implies by its fields alone, composed shapes united; fixed conditions, in the order of the markers' passes.
IMPLIED = {
    "add-zero": "(arith_opcode = 0 and rhs_mode = 0) or extra_opcode = 1", "sub-zero": "arith_opcode = 1 and rhs_mode = 0", "mul-one": "(arith_opcode = 2 and rhs_mode = 1) or extra_opcode = 2",
    "xor-self": "extra_opcode = 3", "or-zero": "arith_opcode = 4 and rhs_mode = 0", "and-allones": "arith_opcode = 5 and rhs_mode = 3 and const_a = -1", "and-self": "extra_opcode = 5", "dead-arithmetic": "extra_opcode = 4",
    "diamond": "shape = 1", "nested-diamond": "shape = 2", "unreachable-tail": "shape = 3", "switch-like-chain": "shape = 4",
    "promotable-alloca": "memory_shape in (1, 2)", "store-load-forward": "memory_shape in (1, 2)", "dead-store": "memory_shape = 3", "overwritten-store": "memory_shape = 4", "redundant-load": "memory_shape = 2", "unused-alloca": "memory_shape = 5",
    "canonical-header": "loop_shape <> 0", "induction-phi": "loop_shape <> 0", "simple-trip-count": "loop_shape <> 0", "invariant-op": "loop_shape = 3", "dead-loop-instruction": "loop_shape = 4", "loop-exit": "loop_shape <> 0",
}
_FREE = "(compose_bits <> 0 or (global_shape = 0 and vector_shape = 0))"
_STATIC = {k: f"{_FREE} and ({v})" for k, v in IMPLIED.items()} | {"dead-initializer": "global_shape <> 0"}
_STATIC |= {f"vector.{m}": f"vector_shape = {i + 1} and (compose_bits <> 0 or global_shape = 0)" for i, m in enumerate(probes.VECTOR_MARKERS)}


@query("static_coverage", f"with c as ({_SHAPED_SQL}), f as (select unnest(list_filter([{', '.join(f'''case when {v} then '{k}' end''' for k, v in _STATIC.items())}], lambda x: x is not null)) as flag, compose_bits <> 0 as composed from c) select flag, composed, count(*) as n from f group by all")
def _static(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.array_compact(F.array(*[F.when(F.expr(v), F.lit(k)) for k, v in _STATIC.items()]))
    return _shaped(spark, sf_dir).select(F.explode(flags).alias("flag"), (F.col("compose_bits") != 0).alias("composed")).groupBy("flag", "composed").agg(F.count(F.lit(1)).alias("n"))


_TARGET = "probe.dse.overwritten-store"


def _reduce_sql() -> str:
    parts, last = [f"c0 as (select * from ({_SHAPED_SQL}) where {probes.CLOSED[_TARGET]})"], "c0"
    for k, f in enumerate(probes.REDUCED, 1):
        parts.append(f"c{k} as (select * replace ({probes.smaller(f, _TARGET)} as {f}) from {last})")
        last = f"c{k}"
    return f"with {', '.join(parts)} select seed, {', '.join(f'{f}::BIGINT as {f}' for f in configs.FIELDS)} from {last}"


@query("marker_reduce", _reduce_sql())
def _reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.reduced(_shaped(spark, sf_dir).where(probes.CLOSED[_TARGET]), _TARGET).select("seed", *configs.FIELDS)


