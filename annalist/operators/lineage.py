"""Closures over lineage edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.operators.shared import settled


def roots(parents: DataFrame, node: str, parent: str) -> DataFrame:
    """Each node of a forest with its root and depth, by doubling the jump in every round.

    A node without a parent row is a root. Rounds grow with the logarithm of the depth. Nodes on a cycle, or
    below one, have no root: theirs and their depth are null.
    """
    edges = settled(parents.where(F.col(parent).isNotNull()).select(F.col(node).alias("n"), F.col(parent).alias("p")))
    above = edges.select(F.col("n").alias("m"))
    jumps, most, reach = edges.withColumn("d", F.lit(1).cast("long")), edges.count(), 1
    while reach <= most and jumps.join(above, F.col("p") == F.col("m"), "left_semi").take(1):
        further = jumps.select(F.col("n").alias("m"), F.col("p").alias("q"), F.col("d").alias("e"))
        grown = jumps.join(further, F.col("p") == F.col("m"), "left")
        jumps, reach = settled(grown.select("n", F.coalesce("q", "p").alias("p"), (F.col("d") + F.coalesce("e", F.lit(0))).alias("d"))), reach * 2
    endless = jumps.join(above, F.col("p") == F.col("m"), "left_semi").select("n", F.lit(True).alias("endless"))
    heads = parents.select(F.col(node).alias("n")).join(jumps, "n", "left").join(endless, "n", "left")
    ends = F.col("endless").isNull()
    return heads.select(F.col("n").alias(node), F.when(ends, F.coalesce("p", "n")).alias("root"), F.when(ends, F.coalesce("d", F.lit(0))).cast("int").alias("depth"))


#: Rounds that follow edges one by one before chains are contracted.
PLAIN = 4


def _jumps(edges: DataFrame) -> list[DataFrame]:
    """(x, y): y is 2^k steps behind x, for k = 0, 1, ..., along nodes that have one edge out. Each table is the last one joined with itself; short chains drop out of it."""
    single = edges.groupBy("x").agg(F.count("*").alias("n"), F.min("y").alias("y")).where("n = 1").select("x", "y")
    tables, most = [settled(single)], edges.count()
    while 2 ** len(tables) <= most:
        a, b = tables[-1].alias("a"), tables[-1].alias("b")
        further = settled(a.join(b, F.col("a.y") == F.col("b.x")).select("a.x", "b.y"))
        if further.isEmpty():
            break
        tables.append(further)
    return tables


def reachable(edges: DataFrame, source: str, target: str, start: DataFrame) -> DataFrame:
    """All nodes reached from `start` (one column) along edges, themselves included. Nodes may have any number of edges, and cycles.

    A few rounds follow only what the last one added. Where that does not end, chains of nodes with one edge out are passed in jumps of 2^k edges: from a set of nodes, the jumps
    for k from the largest to 0 mark all that lies on their chains, since every distance is a sum of such jumps. Rounds grow with the logarithm of the longest
    chain, and with the number of nodes with several edges on a path. No round writes more than it adds.
    """
    name = start.columns[0]
    edges = edges.select(F.col(source).alias("x"), F.col(target).alias("y")).where("x IS NOT NULL AND y IS NOT NULL").distinct()
    found, jumps = [settled(start.select(F.col(name).alias("node")).where("node IS NOT NULL").distinct())], None

    def added(nodes: DataFrame) -> bool:
        new = settled(nodes.distinct().join(reduce(DataFrame.union, found), "node", "left_anti"))
        found.append(new)
        return not new.isEmpty()

    step = lambda nodes, along: nodes.join(along, F.col("node") == F.col("x")).select(F.col("y").alias("node"))
    rounds = 0
    while added(step(found[-1], edges)):
        rounds += 1
        if rounds < PLAIN:
            continue
        if jumps is None:
            edges = settled(edges)
            jumps = _jumps(edges)
        begun = len(found) - 1
        for table in reversed(jumps):
            added(step(reduce(DataFrame.union, found[begun:]), table))
        fresh = reduce(DataFrame.union, found[begun:])
        found[begun:] = [settled(fresh)]
    return reduce(DataFrame.union, found).select(F.col("node").alias(name))
