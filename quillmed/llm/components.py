"""Connected components by min-label hooking and pointer jumping (the FastSV scheme)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u, v) -> (node, root), root the smallest node of the component.

    Every round joins each edge with its neighbour's grandparent, hooks roots to the smallest
    one seen and halves all paths, so rounds grow with the logarithm of the diameter. All
    grouping is by min(), which combines before the shuffle, so a hub costs no more than the
    number of tasks. Parents only fall, so an unchanged sum means a fixed point.
    """
    both = written(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct(), "cc-edges")
    parents = written(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("parent")), "cc-parents")
    total = parents.agg(F.sum(F.col("parent").cast("decimal(20,0)"))).first()[0]
    for _ in range(max_rounds):
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        tree = parents.join(up.hint("shuffle_merge"), "parent")
        seen = (both.join(tree.select(F.col("node").alias("v"), "grand").hint("shuffle_merge"), "v")
                .groupBy(F.col("u").alias("node")).agg(F.min("grand").alias("low")))
        met = tree.join(seen.hint("shuffle_merge"), "node")
        offers = met.select(F.explode(F.array(
            F.struct("node", F.least("low", "grand").alias("parent")),
            F.struct(F.col("parent").alias("node"), F.col("low").alias("parent")))).alias("o")).select("o.*")
        parents = written(offers.groupBy("node").agg(F.min("parent").alias("parent")), "cc-parents")
        now = parents.agg(F.sum(F.col("parent").cast("decimal(20,0)"))).first()[0]
        if now == total:
            break
        total = now
    else:
        raise RuntimeError("connected components did not settle")
    return parents.select("node", F.col("parent").alias("root"))
