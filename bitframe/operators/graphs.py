"""Graphs as edge tables: reachability to a fixed point, dominators, loop headers, paths and contracts, by rounds of joins.

Where there are many small graphs, dominators and loop headers of those with up to SMALL edges are found beside each other, a row for each graph, after one shuffle of the
edges; larger graphs go through rounds of joins. Results don't depend on which way a graph goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..checkpoints import checkpointed
from ..shipping import ship

SMALL = 256  # edges (repeated ones counted) that a graph may have in one row
BLOCK = 100_000  # numbers that a batch of results holds


def reachable(edges: DataFrame, starts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, node, hops of all nodes reached from ``starts`` (by, node) over ``edges`` (by, src, dst), with the fewest hops.

    Each round joins only what the round before found; rounds end when one finds nothing. Repeated edges and loops do no harm; a start that has no
    edge is reached with 0 hops. Nulls reach nothing.
    """
    keys = [*by, "node"]
    edges = checkpointed(edges.select(*by, "src", "dst").where("src is not null and dst is not null").distinct())
    front = seen = checkpointed(starts.select(*keys).where("node is not null").distinct().withColumn("hops", F.lit(0).cast("bigint")))
    hops = 0
    while not front.isEmpty():
        hops += 1
        step = front.select(*keys).join(edges.withColumnRenamed("src", "node"), keys).select(*by, F.col("dst").alias("node")).distinct()
        front = checkpointed(step.join(seen.select(*keys), keys, "left_anti").withColumn("hops", F.lit(hops).cast("bigint")))
        seen = seen.unionByName(front)
        seen = checkpointed(seen) if hops % 8 == 0 else seen
    return seen


def dominating(edges: list[tuple[Any, Any]], roots: list[Any]) -> dict[Any, list[Any]]:
    """The sorted dominators of each node of one small graph that its roots reach; a root has only itself."""
    follow: dict[Any, set] = {}
    for a, b in edges:
        follow.setdefault(a, set()).add(b)
    order = list(roots)
    place = {n: i for i, n in enumerate(order)}
    for n in order:  # grows as nodes are reached
        for m in follow.get(n, ()):
            if m not in place:
                place[m] = len(order)
                order.append(m)
    before: list[list[int]] = [[] for _ in order]
    for n in order:
        for m in follow.get(n, ()):
            before[place[m]].append(place[n])
    every = (1 << len(order)) - 1
    of = [1 << i if i < len(roots) else every for i in range(len(order))]
    moved = True
    while moved:
        moved = False
        for i in range(len(roots), len(order)):
            new = every
            for j in before[i]:
                new &= of[j]
            new |= 1 << i
            if new != of[i]:
                of[i], moved = new, True
    return {n: sorted(m for m, j in place.items() if of[i] >> j & 1) for n, i in place.items()}


def _in_rows(edges: DataFrame, roots: DataFrame, tell: Callable[[set, dict], list[tuple]], schema: StructType) -> DataFrame:
    """What ``tell`` (edges, dominators of each node) says of each graph, as rows of ``schema``, which begins with the graph."""
    ship(edges.sparkSession)
    rows = edges.select("graph", F.struct("src", "dst").alias("e"), F.lit(None).cast(roots.schema["node"].dataType).alias("root"))
    rows = rows.unionByName(roots.select("graph", F.col("node").alias("root")), allowMissingColumns=True)
    rows = rows.groupBy("graph").agg(F.collect_list("e").alias("e"), F.collect_set("root").alias("roots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, roots_of = batch.column(1), batch.column(2)
            src, dst, starts = pairs.values.field(0).to_pylist(), pairs.values.field(1).to_pylist(), roots_of.values.to_pylist()
            at, upto = pairs.offsets.to_pylist(), roots_of.offsets.to_pylist()
            kind = pairs.type.value_type.field(1).type
            kinds = [pa.list_(kind) if isinstance(f.dataType, ArrayType) else kind for f in schema.fields[1:]]
            found, of, size = [], [], 0

            def block() -> pa.RecordBatch:
                columns = [pa.array(list(c), k) for c, k in zip(zip(*found), kinds)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *columns], schema.names)

            for i in range(batch.num_rows):
                own = set(zip(src[at[i] : at[i + 1]], dst[at[i] : at[i + 1]]))
                sets = dominating(own, starts[upto[i] : upto[i + 1]])
                told = tell(own, sets)
                found += told
                of += [i] * len(told)
                size += sum(len(x) for t in told for x in t if isinstance(x, list)) + len(told)
                if size > BLOCK:
                    yield block()
                    found, of, size = [], [], 0
            if found:
                yield block()

    return rows.where(F.size("roots") > 0).mapInArrow(run, schema)


def _by_size(edges: DataFrame, roots: DataFrame, tell: Callable[[set, dict], list[tuple]], schema: StructType, rounds: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    edges = edges.select("graph", "src", "dst").where("graph is not null and src is not null and dst is not null")
    roots = roots.select("graph", "node").where("graph is not null and node is not null")
    large = checkpointed(edges.groupBy("graph").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SMALL).select("graph"))
    if large.isEmpty():
        return _in_rows(edges, roots, tell, schema)
    few, many = ((t.join(large, "graph", "left_anti") for t in (edges, roots)), (t.join(large, "graph", "left_semi") for t in (edges, roots)))
    return _in_rows(*few, tell, schema).unionByName(rounds(*many))


def _fields(edges: DataFrame, **more: str) -> StructType:
    """graph, and fields that are nodes or arrays of nodes."""
    node = edges.schema["dst"].dataType
    return StructType([StructField("graph", edges.schema["graph"].dataType), *[StructField(n, ArrayType(node) if k == "array" else node) for n, k in more.items()]])


def dominators(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """graph, node, dominators (sorted) of all nodes that a graph's root reaches: those on every path to it, itself included.

    edges: graph, src, dst. roots: graph, node. Repeated edges and roots do no harm; null graphs and nodes are left out.
    """
    return _by_size(edges, roots, lambda own, sets: list(sets.items()), _fields(edges, node="node", dominators="array"), by_rounds)


def headers(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """graph, header, tail of edges that lead back to a node that dominates their source: loop_headers() of dominators(), without a table of them for small graphs."""
    back = lambda own, sets: [(b, a) for a, b in own if b in sets.get(a, ())]
    return _by_size(edges, roots, back, _fields(edges, header="node", tail="node"), lambda e, r: loop_headers(e, by_rounds(e, r)))


def by_rounds(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The same as dominators() by rounds of joins, for graphs of any size.

    A node's set is itself and what the sets of all its predecessors share; rounds end when none changes. Sets are no larger than a graph.
    """
    alive = reachable(edges, roots, ("graph",)).select("graph", "node")
    edges = checkpointed(edges.select("graph", "src", "dst").distinct().join(alive.withColumnRenamed("node", "src"), ["graph", "src"], "left_semi"))
    every = alive.groupBy("graph").agg(F.sort_array(F.collect_set("node")).alias("all"))
    is_root = roots.select("graph", "node").distinct().withColumn("root", F.lit(True))
    known = alive.join(every, "graph").join(is_root, ["graph", "node"], "left")
    known = checkpointed(known.select("graph", "node", F.coalesce("root", F.lit(False)).alias("root"), F.when(F.col("root"), F.array("node")).otherwise(F.col("all")).alias("dominators")))
    while True:
        before = known.select("graph", F.col("node").alias("src"), F.col("dominators").alias("of"))
        gathered = edges.join(before, ["graph", "src"]).groupBy("graph", F.col("dst").alias("node")).agg(F.collect_list("of").alias("sets"))
        shared = F.aggregate(F.slice("sets", F.lit(2), F.greatest(F.size("sets") - 1, F.lit(0))), F.col("sets")[0], lambda a, s: F.array_intersect(a, s))
        after = known.join(gathered.select("graph", "node", shared.alias("shared")), ["graph", "node"], "left")
        new = F.when(F.col("root") | F.col("shared").isNull(), F.col("dominators")).otherwise(F.sort_array(F.array_union("shared", F.array("node"))))
        after = checkpointed(after.select("graph", "node", "root", new.alias("new"), (new != F.col("dominators")).alias("moved")))
        known = after.select("graph", "node", "root", F.col("new").alias("dominators"))
        if after.where("moved").isEmpty():
            return known.select("graph", "node", "dominators")


def loop_headers(edges: DataFrame, dominated: DataFrame) -> DataFrame:
    """graph, header, tail of edges that lead back to a node that dominates their source."""
    back = edges.join(dominated.withColumnRenamed("node", "src"), ["graph", "src"]).where(F.array_contains("dominators", F.col("dst")))
    return back.select("graph", F.col("dst").alias("header"), F.col("src").alias("tail")).distinct()


def paths_exist(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """path, n_steps, exists: does every step of a path (graph, path, nodes) have its edge? A path of one node exists."""
    steps = paths.select("graph", "path", F.posexplode_outer(F.zip_with(F.expr("slice(nodes, 1, greatest(size(nodes) - 1, 0))"), F.expr("slice(nodes, 2, greatest(size(nodes) - 1, 0))"), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))))
    met = steps.select("graph", "path", "col.src", "col.dst").join(edges.select("graph", "src", "dst", F.lit(True).alias("there")).distinct(), ["graph", "src", "dst"], "left")
    return met.groupBy("path").agg(F.count("src").alias("n_steps"), F.bool_and(F.col("src").isNull() | F.coalesce("there", F.lit(False))).alias("exists"))
