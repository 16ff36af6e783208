"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

EDGES = 250_000  # of a partition: a shuffle of fewer writes more files than rows are worth


def components(edges: DataFrame) -> DataFrame:
    """node, root of each node of the edges (a, b): root is the smallest node that it is connected with.

    Alternating large-star and small-star steps (Kiveris et al., 2014), which take a number of rounds of the
    order of the logarithm of the nodes; a step moves each edge to a node's smallest neighbour. The smallest
    neighbours are aggregated before the shuffle and joined back, so a node with very many edges is one row
    of one side, and Spark splits the other.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    parts = -(-edges.count() // EDGES) or 1

    def few(df: DataFrame) -> DataFrame:
        return df.coalesce(parts)

    edges, before = few(edges), None
    while True:
        both = few(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = few(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = few(large.where("u <> v").distinct())
        least = few(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = few(large.join(least, "u"))
        small = few(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))
        edges = cut(few(small.where("u <> v").distinct()))
        # an unchanged edge set is the end: then each node hangs on its root
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
