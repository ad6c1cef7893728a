"""Connected components as Spark jobs: alternating large and small stars.

Every step is one aggregate per node (partial sums first, so a hub is one row per task),
a join back and a distinct; the number of steps grows with the logarithm of
the nodes.  Steps are cut with reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: neighbours above a node go to the smallest of all its neighbours.
    Small star: a node and its neighbours below go to the smallest of them."""
    if large:
        e = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        e = edges
    low = e.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    j = e.join(low, "a")
    if large:
        out = j.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = j.select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionByName(low.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, component): the smallest node reachable.  Nodes
    that appear only with themselves are components of their own."""
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    e = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                         .filter("a > b").distinct())
    before = None
    while True:
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
        e = cut_lineage(_star(_star(e, True), False))
    return nodes.join(e.select(F.col("a").alias("node"), "b"), "node", "left") \
        .select("node", F.coalesce("b", "node").alias("component"))
