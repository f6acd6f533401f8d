"""Operators of users: Column builders and Python table functions, which are let in only if they agree with a reference on a battery of inputs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..shipping import ship


class Refused(ValueError):
    """An operator that isn't known, hasn't been tried, or disagreed with its reference."""


class Scalar(NamedTuple):
    """A builder of a bigint Column from one, and what it has to agree with: a Python function of one number."""

    name: str
    build: Callable[[Column], Column]
    reference: Callable[[int], int | None]


class Table(NamedTuple):
    """A Python table function of one number, which gives rows of one bigint, and what it has to agree with: a builder of an array of bigint."""

    name: str
    function: type
    reference: Callable[[Column], Column]


def _referenced(reference: Callable[[int], int | None]) -> Callable:
    @F.pandas_udf("struct<value:bigint,failed:boolean>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for xs in batches:
            values, failed = [], []
            for x in xs.tolist():
                try:
                    values.append(reference(x))
                    failed.append(False)
                except Exception:  # noqa: BLE001  whatever a user's function raises counts against it
                    values.append(None)
                    failed.append(True)
            yield pd.DataFrame({"value": pd.array(values, "Int64"), "failed": failed})

    return run


class Registry:
    """Proposed operators by name; ``admit`` decides once, by the battery that it is given, which of them ``apply`` lets in."""

    def __init__(self, proposals: list) -> None:
        self.proposals = {p.name: p for p in proposals}
        if len(self.proposals) < len(proposals):
            raise ValueError("names of operators repeat")
        self.admitted: set[str] = set()

    def _table(self, rows: DataFrame, p: Table, of: str, out: str) -> DataFrame:
        """``rows`` with a row for each result of the function."""
        spark, name = rows.sparkSession, "bitframe_" + "".join(c if c.isalnum() else "_" for c in p.name)
        ship(spark)
        spark.udtf.register(name, F.udtf(p.function, returnType="value bigint"))
        return spark.sql(f"select r.*, t.value as `{out}` from {{rows}} r, lateral {name}(r.`{of}`) t", rows=rows)

    def verdicts(self, battery: DataFrame) -> DataFrame:
        """name, kind, checked, disagreements, witness (the least input that shows one), admitted. battery: one column of numbers; equal ones are tried once, nulls not at all.

        A reference that fails on an input disagrees on it. An empty battery admits nothing. Results of table functions are compared as sorted lists.
        """
        x = battery.columns[0]
        tried = checkpointed(battery.select(F.col(x).cast("bigint").alias("x")).where("x is not null").distinct())
        out = None
        for p in self.proposals.values():
            if isinstance(p, Scalar):
                both = tried.select("x", p.build(F.col("x")).cast("bigint").alias("own"), _referenced(p.reference)(F.col("x")).alias("r"))
                both = both.select("x", (F.col("r.failed") | ~F.col("own").eqNullSafe(F.col("r.value"))).alias("bad"))
            else:
                made = self._table(tried, p, "x", "value").groupBy("x").agg(F.sort_array(F.collect_list("value")).alias("own"))
                empty = F.lit([]).cast("array<bigint>")
                both = tried.join(made, "x", "left").select("x", (F.coalesce("own", empty) != F.sort_array(F.coalesce(p.reference(F.col("x")), empty))).alias("bad"))
            kind = "scalar" if isinstance(p, Scalar) else "table"
            part = both.agg(F.count(F.lit(1)).alias("checked"), F.count_if("bad").alias("disagreements"), F.min(F.when(F.col("bad"), F.col("x"))).alias("witness"))
            part = part.select(F.lit(p.name).alias("name"), F.lit(kind).alias("kind"), "*", ((F.col("checked") > 0) & (F.col("disagreements") == 0)).alias("admitted"))
            out = part if out is None else out.unionByName(part)
        return out

    def admit(self, battery: DataFrame) -> set[str]:
        """Try all proposals and remember those that agree."""
        self.admitted = {r["name"] for r in self.verdicts(battery).where("admitted").select("name").collect()}  # a row for each proposal
        return self.admitted

    def apply(self, rows: DataFrame, name: str, of: str, out: str) -> DataFrame:
        """``rows`` with a column of the operator's results; a table function gives a row for each of them, and none where it gives none."""
        if name not in self.admitted:
            raise Refused(name)
        p = self.proposals[name]
        return rows.withColumn(out, p.build(F.col(of)).cast("bigint")) if isinstance(p, Scalar) else self._table(rows, p, of, out)
