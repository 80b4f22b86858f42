"""Connected components of an edge list, without leaving Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.session import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node of it) of all nodes in edges (src, dst).

    Alternating large-star and small-star rounds, until one changes nothing. A star is a min by node,
    combined before its shuffle, joined back to the edges by node; the edges of a hub are many rows of one
    key on one side of that join, which adaptive execution splits into several tasks (spark.sql.adaptive.skewJoin).
    Self loops keep a node; null ends are dropped. No edges give no rows.
    """
    e = edges.where("src is not null and dst is not null").select("src", "dst")
    pairs = checkpointed(e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    while True:
        # large star: neighbours greater than a node are linked to its least neighbour
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        keep = pairs.where("u = v")
        large = large.unionByName(keep).distinct()
        # small star: a node's lesser neighbours and itself are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").distinct()
        pairs = checkpointed(small)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state == before:
            break
        before = state
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
