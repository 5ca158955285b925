"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import forget, written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of each node of edges(a long, b long): the smallest node that links reach.

    Each round is one large-star step (every node's larger neighbours go to its smallest) and one small-star step
    (every node's smaller neighbours go to the smallest), so rounds grow with the logarithm of the longest path. A
    round's edges are written to the shared folder and the round's before are removed: lineage stays short and lost
    executors cost one round. A node with very many neighbours is met by partial aggregation and by a join that Spark
    can split, never by one group.

    Empty input gives no rows; edges with a null end and self-loops are left out.
    """
    both = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = written(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        # the edges are a set of stars once each node has one parent that is no child; then they no longer change
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        large = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = large.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(small, "u")
        down = down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        last, now = now, written(down.distinct(), "edges")
        forget(last)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    heads = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
