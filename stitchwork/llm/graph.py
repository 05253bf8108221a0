"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stitchwork.llm.common import settle


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """node, root (the smallest node reachable) for every node of an edge; both columns are orderable keys.

    Rounds of large-star and small-star: every node points its larger
    neighbours, then all its smaller ones, at the smallest neighbour it knows.
    Only minima per node are gathered, so a node with millions of links costs a
    partial aggregate and a join that adaptive execution may split. Each round
    is written to the checkpoint folder. Rounds grow with the logarithm of the
    longest chain; only the number of changed links reaches the driver.
    """
    now = settle(edges.select(F.least(src, dst).alias("lo"), F.greatest(src, dst).alias("hi"))
                 .filter("lo <> hi").distinct())
    while True:
        both = now.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(
            now.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
        least = both.groupBy("node").agg(F.min("other").alias("m"))
        least = least.select("node", F.least("node", "m").alias("m"))
        # Large star: larger neighbours of a node point at its minimum.
        large = (both.filter("other > node").join(least, "node")
                 .select(F.col("m").alias("lo"), F.col("other").alias("hi")).filter("lo < hi").distinct())
        # Small star: a node and its smaller neighbours point at its minimum.
        least = large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m"))
        met = large.select(F.col("hi").alias("node"), "lo").join(least, "node")
        small = (met.select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
                 .unionByName(least.select(F.col("m").alias("lo"), F.col("node").alias("hi")))
                 .filter("lo < hi").distinct())
        after = settle(small)
        changed = after.join(now, ["lo", "hi"], "left_anti").limit(1).count()
        same_size = after.count() == now.count()
        now = after
        if not changed and same_size:
            break
    members = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return members.unionByName(roots)
