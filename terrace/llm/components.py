"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_shuffles, drop_written, written


def _smaller_neighbour(edges: DataFrame) -> DataFrame:
    """hi, m: the smallest node that a node shares an edge with, itself included. Partial minima keep a hot node's rows apart."""
    return edges.groupBy("hi").agg(F.min("lo").alias("m"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of the edges (u, v: bigint), root the smallest node reachable.

    Each round joins every node's neighbours to its smallest one (first the larger
    neighbours, then the smaller ones); the number of rounds follows the logarithm of
    the components' size. Nothing is collected but a digest of the edge table, and each
    round's table is written to the shared scratch folder. A hot node is only ever one
    side of an equi-join, which adaptive execution splits. No edges: no rows. Loops and
    edges with a null are ignored.
    """
    u, v = F.col("u"), F.col("v")
    now = written(edges.where(u != v).select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo")).distinct(), "edges")
    digest = None
    for _ in range(rounds):
        both = now.select("hi", "lo").unionAll(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = _smaller_neighbour(both).select("hi", F.least("hi", "m").alias("m"))
        large = both.where(F.col("lo") > F.col("hi")).join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        large = written(large, "edges")
        least = _smaller_neighbour(large)
        small = large.join(least, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()
        small = written(small, "edges")
        found = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("lo", "hi"))).first()
        drop_written(now)
        drop_written(large)
        now = small
        collect_shuffles(edges.sparkSession)
        if found == digest:
            break
        digest = found
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("lo").alias("node")).distinct().join(now.select(F.col("hi").alias("node")), "node", "left_anti")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(roots.select("node", F.col("node").alias("root")))
