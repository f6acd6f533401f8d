"""The last definition before each use, on a stream: keyed state with timers, rows in the order of their times, old definitions forgotten."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import ordered
from ..shipping import ship

RESULT = "user string, row bigint, definition bigint, found string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def base_of(symbol: Column) -> Column:
    """The name before the first dot."""
    return F.split_part(symbol, F.lit("."), F.lit(1))


def last(rows: DataFrame, keep: int) -> DataFrame:
    """user, row, definition, found: for each use its symbol's last definition (its row) before it, else that of its base name; found: exact, base or null.

    rows: user, at (microseconds), row, symbol, defines. Rows of a user are in order of (at, row). A definition counts for ``keep`` microseconds. Null users are a user; rows
    of a null time or symbol are left out.
    """
    rows = rows.where("at is not null and symbol is not null").withColumn("base", base_of(F.col("symbol")))
    order, said = ["at", "row"], F.struct(F.col("row").alias("def"), F.col("at").alias("then"))
    out = ordered.carried(rows, ["user", "symbol"], order, F.when(F.col("defines"), said), "exact", own=False)
    out = ordered.carried(out, ["user", "base"], order, F.when(F.col("defines") & (F.col("symbol") == F.col("base")), said), "near", own=False).where("not defines")
    fresh = {c: F.col("at") - F.col(f"{c}.then") <= keep for c in ("exact", "near")}
    found = F.when(fresh["exact"], "exact").when(fresh["near"], "base")
    return out.select(F.col("user").cast("string").alias("user"), "row", F.when(fresh["exact"], F.col("exact.def")).when(fresh["near"], F.col("near.def")).alias("definition"), found.alias("found"))


class Definitions(StatefulProcessor):
    """Rows wait until the watermark has passed their time; then they are worked on in order. Definitions leave the state when they no longer count.

    Each call of the state goes to another process, so there are a few for each user and batch, and none for each row.
    """

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, row bigint, symbol string, defines boolean")
        self.known = handle.getMapState("known", "symbol string", "row bigint, at bigint")
        self.next = handle.getValueState("next", "at bigint")  # the earliest time that waits

    def waits(self, at: int) -> None:
        """``at`` is the earliest time that waits: one timer for it, whatever waits behind it."""
        self.next.update((at,))
        self.handle.registerTimer(-(-at // 1000))  # timers count milliseconds

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        earliest = None
        for batch in rows:
            new = list(zip(batch["at"].tolist(), batch["row"].tolist(), batch["symbol"].tolist(), batch["defines"].tolist()))
            if new:
                self.waiting.appendList(new)
                first = min(new)[0]
                earliest = first if earliest is None else min(first, earliest)
        if earliest is not None and not (self.next.exists() and self.next.get()[0] <= earliest):
            self.waits(earliest)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        if not self.next.exists() or self.next.get()[0] > now:
            return  # an earlier timer of this batch has done it all
        every = list(map(tuple, self.waiting.get()))
        due, left = sorted(x for x in every if x[0] <= now), [x for x in every if x[0] > now]
        known = {k[0]: tuple(v) for k, v in self.known.iterator()}
        before, out = dict(known), []
        for at, row, symbol, defines in due:
            if defines:
                known[symbol] = (row, at)
            else:
                found = (None, None)
                for name, how in ((symbol, "exact"), (symbol.split(".", 1)[0], "base")):
                    said = known.get(name)
                    if said and at - said[1] <= self.keep:
                        found = (said[0], how)
                        break
                out.append((key[0], row, *found))
        for name, said in known.items():
            if now - said[1] > self.keep:
                if name in before:
                    self.known.removeKey((name,))
            elif before.get(name) != said:
                self.known.updateValue((name,), said)
        if left:
            self.waiting.put(left)
            self.waits(min(left)[0])
        else:
            self.waiting.clear()
            self.next.clear()
        if out:
            table = pd.DataFrame(out, columns=["user", "row", "definition", "found"])
            yield table.astype({"definition": "Int64"})

    def close(self) -> None:
        pass


def streamed(stream: DataFrame, keep: int, delay: str = "1 hour") -> DataFrame:
    """The same on a stream with a column ``time`` beside those of last(): a use is told once the watermark, ``delay`` behind the latest time, has passed it. Later rows are dropped.

    The session's state store has to be RocksDB's (``use_state_store``). User, time and symbol must not be null.
    """
    ship(stream.sparkSession)
    plain = stream.withWatermark("time", delay).select(F.col("user").cast("string").alias("user"), "time", "at", "row", "symbol", "defines")
    return plain.groupBy("user").transformWithStateInPandas(Definitions(keep), RESULT, "Append", "EventTime")


def use_state_store(spark: Any) -> str | None:
    """Set the state store that keyed state with timers needs; returns what was set before."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return before
