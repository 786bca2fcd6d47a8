"""Connected components by alternating large-star and small-star steps over edge tables.

Every step is a partial aggregation (the minimum of a node's neighbours) and a join back, so a
node with very many neighbours is combined before the shuffle and split by adaptive skew joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelace.llm.common import materialize, release


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """edges(a, b) -> (node, component), component the smallest node reachable.

    Loops and repeated edges are fine; null ends are ignored; nodes without an edge do not appear.
    No edges give no rows. Raises if max_rounds doesn't reach the fixed point (never returns a
    partial result); rounds grow with the logarithm of the longest path.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = materialize(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    last = None
    for _ in range(max_rounds):
        # large-star: neighbours above a node link to the least of its neighbourhood
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: neighbours below a node, and itself, link to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        new = materialize(small.where("u <> v").distinct(), "cc")
        # a star forest in which every node has one edge, to a node without one, is the fixed point
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(e)
        e = new
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        last = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
