"""Mixing sources to target weights by min-cost flow over membership patterns.

Sources overlap where equal texts stand in several of them. Texts are counted by pattern, the set of sources that they
stand in. Words flow from patterns to the sources' quotas; the first use of a text is free, wherever it is made, the second costs
more and each further one still more, so a text that several sources have is repeated no more than the quotas ask for. The
flow is solved on the driver over patterns and sources, never documents, and only for sources that overlap; a source by itself
fills its quota alone. Then documents are selected in a seeded order: sums over 4,096 hash buckets find the bucket in which
a quota ends, and only that bucket is ordered.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import table, written

USES, BUCKETS = 3, 4096
COSTS = (0, 1, 3, 6)  # of the first, second and third use of a word, and of more (by copies of a text in other sources)
HINTED = 100_000  # rows of a table made on the driver up to which it is broadcast
WORD = r"[^\x20\x09-\x0D]+"


def shares(sizes: dict, weights: dict, total: float, most: float = USES) -> dict:
    """Targets: ``total`` shared by weight; none above ``most`` times its size, the excess shared again among the others."""
    targets, free, rest = {}, list(sizes), float(total)
    while free:
        whole = sum(weights[s] for s in free)
        over = {s for s in free if rest * weights[s] / whole > most * sizes[s]}
        if not over:
            return targets | {s: rest * weights[s] / whole for s in free}
        targets |= {s: float(most * sizes[s]) for s in over}
        rest -= sum(targets[s] for s in over)
        free = [s for s in free if s not in over]
    return targets


def whole(targets: dict) -> dict:
    """Targets as whole words with the same sum, by largest remainder."""
    out = {s: int(t) for s, t in targets.items()}
    short = round(sum(targets.values())) - sum(out.values())
    for s in sorted(targets, key=lambda s: (out[s] - targets[s], str(s)))[: max(0, short)]:
        out[s] += 1
    return out


def levels(once: int, every: int) -> list[tuple[int, int]]:
    """(words, cost of each) of the uses of a pattern with ``once`` words in different texts, of which ``every`` use is allowed."""
    used = [min(once, max(0, every - k * once)) for k in range(3)]
    return list(zip([*used, every - sum(used)], COSTS))


def flow(pools: dict, quotas: dict) -> dict:
    """Words that go from each pool to each source: a min-cost maximum flow.

    pools: name -> ([(words, cost)] of its uses at rising costs, {source: most words that go there}). Only uses have a cost, and augmenting never takes
    words back from a pool, so a maximum flow over the uses of each cost, cheapest first, on top of the one before, is of least cost. Each is
    found by blocking flows along shortest paths, so thousands of pools do no harm.
    """
    room: dict = {s: {} for s in quotas}  # source -> pool -> words that may still go there
    sent: dict = {p: {s: 0 for s in rooms if s in quotas} for p, (_, rooms) in pools.items()}
    for p, (_, rooms) in pools.items():
        for s in sent[p]:
            room[s][p] = rooms[s]
    left, have = dict(quotas), dict.fromkeys(pools, 0)

    def augment() -> bool:
        """A blocking flow from pools with words to sources with quotas left; False if there is no path."""
        far: dict = {("pool", p): 0 for p, words in have.items() if words}
        layer, ends = list(far), False
        while layer and not ends:
            after = []
            for kind, x in layer:
                for y in (sent[x] if kind == "pool" else room[x]):
                    to = ("source" if kind == "pool" else "pool", y)
                    if to not in far and (room[y][x] if kind == "pool" else sent[y][x]) > 0:
                        far[to] = far[kind, x] + 1
                        after.append(to)
                        ends = ends or (kind == "pool" and left[y] > 0)
            layer = after
        if not ends:
            return False
        todo: dict = {}  # node -> the neighbours that may still lead on
        for first in [p for p, words in have.items() if words]:
            path = [("pool", first)]
            while path and have[first]:
                kind, x = path[-1]
                if kind == "source" and left[x] > 0:
                    steps = list(zip(path, path[1:]))
                    words = min(have[first], left[x], *[room[b[1]][a[1]] if a[0] == "pool" else sent[b[1]][a[1]] for a, b in steps])
                    for a, b in steps:
                        p, s, by = (a[1], b[1], words) if a[0] == "pool" else (b[1], a[1], -words)
                        sent[p][s] += by
                        room[s][p] -= by
                    have[first] -= words
                    left[x] -= words
                    path = path[:1]
                    continue
                if path[-1] not in todo:
                    todo[path[-1]] = list(sent[x] if kind == "pool" else room[x])
                on = todo[path[-1]]
                while on:
                    to = ("source" if kind == "pool" else "pool", on[-1])
                    if far.get(to) == far[kind, x] + 1 and (room[on[-1]][x] if kind == "pool" else sent[on[-1]][x]) > 0:
                        path.append(to)
                        break
                    on.pop()
                else:
                    path.pop()
                    if path:
                        todo[path[-1]].pop()
        return True

    for cost in sorted({c for uses, _ in pools.values() for _, c in uses}):
        for p, (uses, _) in pools.items():
            have[p] += sum(words for words, c in uses if c == cost)
        while augment():
            pass
    return {(p, s): sent[p].get(s, 0) for p, (_, rooms) in pools.items() for s in rooms}


def _named(source):  # noqa: ANN001, ANN202
    return (source is None, source or "")


def _measured(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``docs`` with their size, their place in the seeded order and its bucket."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), text)
    out = docs.withColumns({"__source": F.col(source_col).cast("string"), "__size": F.regexp_count(text, F.lit(WORD)).cast("bigint"), "__row": row, "__text": F.xxhash64(text)})
    return out.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), F.col("__row")), F.lit(BUCKETS)))


def _hinted(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= HINTED else df


class Plan(NamedTuple):
    """pooled: units with __pattern (null: the own pool of __of). cuts: a row for each pool that is used. sizes, targets: by source."""

    pooled: DataFrame
    cuts: DataFrame
    sizes: dict
    targets: dict


def _overlaps(units: DataFrame, members: bool, copies: bool) -> tuple[DataFrame, dict]:
    """(units with __pattern and __of, pattern -> (its sources, words of its different texts)) for all patterns of several sources."""
    told = lambda df: {r["__pattern"]: ([m["__source"] for m in r["m"]], r["once"]) for r in df.collect()}
    if members:
        named = units.withColumn("__pattern", F.when(F.size("__members") > 1, F.md5(F.to_json(F.struct("__members")))))
        patterns = told(named.where("__size > 0 and __pattern is not null").groupBy("__pattern").agg(F.transform(F.first("__members"), lambda m: F.struct(m.alias("__source"))).alias("m"), F.sum("__size").alias("once")))
        return named.withColumn("__of", F.when(F.col("__pattern").isNull(), F.col("__members")[0])), patterns
    alone = units.withColumns({"__pattern": F.lit(None).cast("string"), "__of": F.col("__source")})
    if not copies:
        return alone, {}
    texts = units.where("__size > 0").groupBy("__text").agg(F.sort_array(F.collect_set(F.struct("__source"))).alias("m"), F.first("__size").alias("once")).where(F.size("m") > 1)
    texts = written(texts.withColumn("__pattern", F.md5(F.to_json("m"))))
    patterns = told(texts.groupBy("__pattern").agg(F.first("m").alias("m"), F.sum("once").alias("once")))
    if not patterns:
        return alone, {}
    return units.join(texts.select("__text", "__pattern"), "__text", "left").withColumn("__of", F.col("__source")), patterns


def routed(rooms: dict, overlaps: dict, quotas: dict, members: bool) -> dict:
    """Words that each pool gives: rooms: (pattern or None, source or None) -> words of its rows. Sources that don't overlap fill their quotas alone."""
    pools: dict = {}
    for pattern, (sources, once) in overlaps.items():
        room = {s: rooms.get((pattern, None if members else s), 0) * USES for s in sources}
        pools[pattern] = levels(once, max(room.values()) if members else sum(room.values())), room
    joined = {s: s for _, room in pools.values() for s in room}  # sources that a pattern ties together, as a forest

    def find(s):  # noqa: ANN001, ANN202
        while joined[s] != s:
            joined[s] = s = joined[joined[s]]
        return s

    for _, room in pools.values():
        first, *others = room
        for s in others:
            joined[find(s)] = find(first)
    groups: dict = defaultdict(dict)
    for pattern, pool in pools.items():
        groups[find(next(iter(pool[1])))][pattern] = pool
    for s in joined:
        own = rooms.get((None, s), 0)
        groups[find(s)][None, s] = levels(own, own * USES), {s: own * USES}
    out: dict = {(None, s): min(words, USES * rooms.get((None, s), 0)) for s, words in quotas.items() if s not in joined}
    for top, group in groups.items():
        for (pool, s), words in flow(group, {s: quotas.get(s, 0) for s in joined if find(s) == top}).items():
            name = pool if isinstance(pool, tuple) else (pool, None if members else s)
            out[name] = out.get(name, 0) + words
    return out


def _plan(units: DataFrame, weights: tuple, members: bool = False, copies: bool = True) -> Plan:
    spark = units.sparkSession
    pooled, overlaps = _overlaps(units, members, copies)
    pooled = written(pooled) if overlaps else pooled
    buckets = written(pooled.groupBy("__pattern", "__of", "__bucket").agg(F.sum("__size").alias("words")))
    rooms = {(r["__pattern"], r["__of"]): r["words"] for r in buckets.groupBy("__pattern", "__of").agg(F.sum("words").alias("words")).collect()}
    sized = units.select(F.explode("__members").alias("__source"), "__size") if members else units
    sizes = {r["__source"]: r["words"] for r in sized.groupBy("__source").agg(F.sum("__size").alias("words")).collect()}
    names = sorted(sizes, key=_named)
    total = sum(rooms.values())
    targets = shares(sizes, {s: weights[i % len(weights)] for i, s in enumerate(names)}, total)
    taken = routed(rooms, overlaps, whole(targets), members)
    rows = [(p, o, *divmod(words, rooms[p, o])) for (p, o), words in taken.items() if words]
    used = _hinted(table(spark, {c: [r[i] for r in rows] for i, c in enumerate(("__p", "__o", "uses", "rest"))}, "__p string, __o string, uses bigint, rest bigint"), len(rows))
    same = F.col("__pattern").eqNullSafe(F.col("__p")) & F.col("__of").eqNullSafe(F.col("__o"))
    upto = F.sum("words").over(Window.partitionBy("__p", "__o").orderBy("__bucket"))  # 4,096 rows at most
    ends = buckets.join(used.where("rest > 0"), same).withColumn("before", upto - F.col("words")).where("before <= rest and before + words > rest")
    ends = _hinted(written(ends.select("__p", "__o", F.col("__bucket").alias("cut"), (F.col("rest") - F.col("before")).alias("left"))), len(rows))
    near = pooled.join(ends, same & (F.col("__bucket") == F.col("cut"))).where("__size > 0").groupBy("__p", "__o", "cut", "left", "__row").agg(F.sum("__size").alias("words"), F.count(F.lit(1)).alias("rows"))
    ahead = F.sum("words").over(Window.partitionBy("__p", "__o").orderBy("__row")) - F.col("words")
    edge = near.withColumn("ahead", ahead).where("ahead <= left and ahead + words > left")
    edge = edge.select("__p", "__o", "cut", F.col("__row").alias("edge"), F.expr("(left - ahead) div rows").alias("more"))
    both = used.alias("u").join(edge.alias("e"), F.col("u.__p").eqNullSafe(F.col("e.__p")) & F.col("u.__o").eqNullSafe(F.col("e.__o")), "left")
    cuts = written(both.select("u.__p", "u.__o", *[F.col(c).alias(f"__{c}") for c in ("uses", "cut", "edge", "more")]))
    return Plan(pooled, _hinted(cuts, len(rows)), sizes, targets)


def _taken(rows: DataFrame, plan: Plan) -> DataFrame:
    """``rows`` (with __pattern, __of, __size, __bucket, __row) and __taken: a projection beside a small table, whatever the rows carry."""
    same = F.col("__pattern").eqNullSafe(F.col("__p")) & F.col("__of").eqNullSafe(F.col("__o"))
    here = F.col("__bucket") == F.col("__cut")
    part = F.when((F.col("__bucket") < F.col("__cut")) | (here & (F.col("__row") < F.col("__edge"))), F.col("__size")).when(here & (F.col("__row") == F.col("__edge")), F.least("__more", "__size"))
    return rows.join(plan.cuts, same, "left").withColumn("__taken", F.coalesce("__uses", F.lit(0)) * F.col("__size") + F.coalesce(part, F.lit(0)))


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", members_col: str | None = None, copies: bool = True) -> DataFrame:
    """doc_id, source, row_hash, size, source_size, target, taken: one row per row of ``docs``.

    size: words in the text (null: 0). Sources in order of code points, null last, weigh ``weights``, repeating. taken: words
    the mix takes: all of a text once, twice or three times, or a part of them where a quota ends. With ``copies``, equal texts of several
    sources are one pattern, and each row counts for its own source. With ``members_col`` (an array) instead, a row counts for
    whichever of these sources the flow routes it to, and a source's size is that of all rows that are its members. Rows of size 0 take nothing. Equal rows
    (by id, source and text) share a place in the seeded order; reruns agree. Other columns are ignored.

    There may be any number of sources and patterns, of any number of sources each, as long as the driver holds a number for each source of each pattern.
    All patterns are in the flow.
    """
    units = _measured(docs, seed, id_col, text_col, source_col)
    kept = ["__source", "__size", "__row", "__text", "__bucket", F.col(id_col).cast("bigint").alias("__id")]
    if members_col:
        sources = F.array_distinct(F.filter(F.col(members_col), lambda m: m.isNotNull()))
        units = units.select(*kept, F.when(F.size(sources) > 0, F.array_sort(sources)).otherwise(F.array("__source")).alias("__members"))
    units = written(units if members_col else units.select(*kept))
    plan = _plan(units, weights, members=bool(members_col), copies=copies)
    out = _taken(plan.pooled, plan)
    goal = table(docs.sparkSession, {"__s": [*plan.sizes], "source_size": [*plan.sizes.values()], "target": [plan.targets[s] for s in plan.sizes]}, "__s string, source_size bigint, target double")
    out = out.join(_hinted(goal, len(plan.sizes)), F.col("__source").eqNullSafe(F.col("__s")), "left")
    return out.select(F.col("__id").alias("doc_id"), F.col("__source").alias("source"), F.col("__row").alias("row_hash"), F.col("__size").alias("size"), "source_size", "target", F.col("__taken").alias("taken"))


def mixed(docs: DataFrame, weights: tuple = (5, 2, 1), seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copies: bool = False) -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole rows as often as they are taken, none cut.

    Of a text at a quota's end, one more copy is taken if half of it or more would be. Each row counts for its own source; with ``copies``, equal texts of several
    sources go through the flow, as in ``mix``. A row's share follows from small tables, of pools and of the texts that sources share; texts are shuffled only where these are many.
    """
    rows = _measured(docs, seed, id_col, text_col, source_col)
    plan = _plan(written(rows.select("__source", "__size", "__row", "__text", "__bucket")), weights, copies=copies)
    shared = written(plan.pooled.where("__pattern is not null").select("__text", "__pattern").distinct()) if copies else None
    if copies and (n := shared.count()):
        rows = rows.join(_hinted(shared, n), "__text", "left")
    else:
        rows = rows.withColumn("__pattern", F.lit(None).cast("string"))
    out = _taken(rows.withColumn("__of", F.col("__source")).where("__size > 0"), plan)
    times = F.expr("cast((2 * __taken + __size) div (2 * __size) as int)")
    return out.withColumn("__times", times).where("__times > 0").withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
