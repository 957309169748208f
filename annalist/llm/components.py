"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm import shared


def _toward_least(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v): ties neighbours of each u to the least of them.

    Neighbours above u if `large`, else those below u and u itself. Only a minimum per node
    is aggregated; no neighbourhood is collected.
    """
    if large:
        pairs = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))
    tied = pairs.join(least, F.col("u") == F.col("node"))
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.least("least", "node").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("least").alias("v")).union(least.select(F.col("node").alias("u"), F.col("least").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; a component is named by its least node.

    `edges` has two long columns u and v. Self loops are ignored. Alternates large and small stars
    until the edges no longer change, which takes rounds in the order of the logarithm of a
    component's size; each step is written to the shared folder, and the one before it deleted.
    """
    edges = shared.written(edges.where("u <> v").distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        edges = shared.written(_toward_least(edges, True), "edges", edges)
        edges = shared.written(_toward_least(edges, False), "edges", edges)
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
