"""Connected components of an edge table, by hash-to-minimum rounds on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.session import stage


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node it can be reached from) for the nodes of ``edges`` (a, b).

    Each round links every node's larger neighbours to its smallest neighbour, then its smaller ones (large and small
    star), until nothing changes. A hub's neighbours are only ever aggregated, never gathered; the number of edges
    doesn't grow. Loops and repeated edges do no harm.
    """
    edges = stage(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "edges")
    last = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_n"), F.least("a", "_m").alias("_m"))
        # Large star: neighbours above a node go to the least node around it.
        up = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("_n")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
        up = stage(up.where(F.col("a") != F.col("b")).distinct(), "edges")
        # Small star: a node and its neighbours below go to the least of them; here a > b always.
        low = up.groupBy("a").agg(F.min("b").alias("_m"))
        ends = up.join(low, "a")
        down = ends.where(F.col("b") != F.col("_m")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
        edges = stage(down.unionByName(low.select("a", F.col("_m").alias("b"))).distinct(), "edges")
        # It is over when every edge leads to a node that has no edge down itself and each node has one.
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        last = now
    raise RuntimeError(f"components not settled after {rounds} rounds")
