"""Connected components of an edge table, by rounds of joins; nothing is collected to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few

#: Edges of a task; rows of two numbers.
EDGES = 100_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Large-star and small-star rounds: each node links its larger neighbours to the smallest one that it knows, then itself and
    its smaller ones. Stars are what remains. Neighbours are reduced to their minimum by a partial aggregate and joined back, so
    a node with very many is never gathered (AQE splits its join). The number of rounds grows as the logarithm of a component's length.
    A round runs in as many tasks as the edges left fill: those of one task are not shuffled.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    last = (e.count(),)
    for _ in range(rounds):
        n = last[0]
        e = few(e, n, EDGES, 1)
        both = few(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), n, EDGES, 1)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = few(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct(), n, EDGES, 1)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = few(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))), n, EDGES, 1)
        e = cut(few(small.filter("u > v").distinct(), n, EDGES, 1))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
