"""Connected components: which things chains of links connect, in rounds that grow with the logarithm of the longest chain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest(links: DataFrame, keep_rows: Callable[[DataFrame], DataFrame], most_rounds: int = 80) -> DataFrame:
    """(node, root) for all ends of ``links`` (u, v): the smallest that is connected with a node.

    Each node points to a smaller one, itself at first.  In a round a node's root and the node itself are hung below the smallest
    grandparent of its neighbours, and then every node below its own grandparent, so paths halve (FastSV: Zhang, Azad, Hu,
    2020).  ``keep_rows`` materialises a round; self links and repeated ones do no harm."""
    both = keep_rows(links.select("u", "v").union(links.select("v", "u")).distinct())
    up = keep_rows(both.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node")))
    mark = lambda df: df.agg(F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()[0]
    seen = mark(up)
    for _ in range(most_rounds):
        grand = up.join(up.select(F.col("node").alias("root"), F.col("root").alias("grand")), "root").select("node", "root", "grand")
        near = both.join(grand.select(F.col("node").alias("v"), "grand"), "v").groupBy(F.col("u").alias("node")).agg(F.min("grand").alias("near"))
        met = grand.join(near, "node")
        offers = met.select("node", F.least("near", "grand").alias("to")).union(met.select("root", "near"))
        least = offers.groupBy("node").agg(F.min("to").alias("to"))
        up = keep_rows(up.join(least, "node").select("node", F.least("root", "to").alias("root")))
        before, seen = seen, mark(up)
        if seen == before:
            return up
    raise RuntimeError("the components did not settle")
