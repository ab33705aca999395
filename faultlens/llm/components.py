"""Connected components of a graph of longs, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.storage import written

#: A node with over a ten-thousandth of all links, and over so many, is joined by broadcast.
SHARE, LEAST_HOT = 10_000, 1000


def _to_least(rows: DataFrame, by: DataFrame, links: int) -> DataFrame:
    """``rows(u, v)`` with m, the smallest of u and its neighbours in ``by(u, v)``.

    Nodes with very many neighbours would each fill one task of the join. Of
    ``by``'s 2 * ``links`` rows at most there are 2 * SHARE such nodes at most, a
    table to broadcast; the other nodes are joined by shuffle.
    """
    least = by.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(
        "u", F.least("u", "m").alias("m"), (F.col("n") > max(LEAST_HOT, links // SHARE)).alias("hot"))
    hot = F.broadcast(least.filter("hot").select("u", "m"))
    return rows.join(hot, "u").unionByName(
        rows.join(hot, "u", "left_anti").join(least.filter("not hot").select("u", "m"), "u"))


def _large_star(edges: DataFrame, links: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.union(edges.select("v", "u"))
    return _to_least(both.filter("v > u"), both, links).select(
        F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame, links: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    own = down.groupBy("u").agg(F.min("v").alias("v"))
    return _to_least(down, down, links).select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        own).filter("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root of every node of ``links(a, b)``; the root is the component's smallest node.

    ``links`` must be a table that reads alike each time, such as a written one.
    Each round halves the distances at least; a round's links are written to the
    shared folder, and the driver sees their number and a sum of hashes only.
    """
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u != v")
    before, n = None, edges.count()
    while True:
        large = written(_large_star(edges, n), "large-star")
        edges = written(_small_star(large, large.count()), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, n = now, now[0]
