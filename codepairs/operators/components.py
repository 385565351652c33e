"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codepairs.session import settle


def _least(pairs: DataFrame, name: str) -> DataFrame:
    """``_node, _least``: the smallest of a node and its neighbours, stored so that the next join stays free to split a hub."""
    found = pairs.groupBy(F.col("u").alias("_node")).agg(F.least(F.min("v"), F.min("u")).alias("_least"))
    return settle(found, name)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` with the smallest node of each component as its root, for every node of an edge.

    Alternates the large-star and small-star steps of Kiveris et al., "Connected
    Components in MapReduce and Beyond" (SoCC 2014), to the fixpoint: a forest in
    which every node hangs on a root. Minimums are aggregates with map-side
    partials, neighbours are joined back from stored tables, so the edges of a
    hub are never gathered and its rows can be split. An edge of a node with itself makes the node known.
    """
    loops = edges.filter("u = v").select("u", "v")
    current = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = settle(current, "components")
    while True:
        down = current.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent"))
        up = current.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
        roles = down.unionByName(up).groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
        if roles.filter("child > 1 or (child = 1 and parent = 1)").isEmpty():
            break
        # Large star: every greater neighbour moves to the smallest neighbour. All edges then point downwards.
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both, "components-large"), F.col("u") == F.col("_node")).filter("v > u")
        large = settle(large.select(F.col("v").alias("u"), F.col("_least").alias("v")).filter("u <> v").distinct(), "components")
        # Small star: a node and its smaller neighbours move to the smallest of them.
        small = large.join(_least(large, "components-small"), F.col("u") == F.col("_node"))
        small = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("_least").alias("v"))
        current = settle(small.filter("u <> v").distinct(), "components")
    rooted = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root"))
    # A loop's node may have other edges; then its root is smaller than itself.
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("root"))
    return rooted.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("root").alias("root"))
