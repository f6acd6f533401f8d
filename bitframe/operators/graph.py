"""Edges whose endpoints aren't nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dangling(edges: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """src, dst of edges with an endpoint that isn't a node, each once; a null endpoint is none."""
    ids = nodes.select(F.col(node).alias("n")).distinct()
    ends = edges.select("src", "dst", F.explode(F.array("src", "dst")).alias("n"))
    return ends.join(ids, "n", "left_anti").select("src", "dst").distinct()
