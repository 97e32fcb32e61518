"""Connected components of a graph that may span the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtrail.session import materialize


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): the smallest node reachable from it.

    Alternates two steps until nothing changes: each node's larger neighbours
    are hung on its smallest one, then its smaller neighbours are.  Both are a
    sum within tasks and a join, whose hot keys AQE splits; the rounds grow
    with the logarithm of the largest component, and each one is written to the
    shared folder, so that a lost executor repeats one round at most.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    now, before = materialize(now, "edges"), None
    while True:
        stamp = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if not stamp.n or stamp == before:
            break
        before = stamp
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        now = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = now.groupBy("u").agg(F.min("v").alias("m"))
        hung = now.join(low, "u")
        now = hung.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(now, "edges")
    top = now.groupBy("v").agg(F.lit(1)).select(F.col("v").alias("node"), F.col("v").alias("label"))
    return now.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").union(top)
