"""Connected components by alternating star contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import checkpointed


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component): the smallest node reachable, for every node with an edge.

    ``edges`` has columns a, b of type long; loops and repeated rows are allowed, null ends are dropped. An
    empty input gives an empty result. Each round is written to the shared folder, so a lost executor costs
    one round at most. Rounds needed grow with the logarithm of the longest path.
    """
    now = checkpointed(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour is attached to the smallest node seen from here.
        both = _both_ways(now)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: the node and its smaller neighbours are attached to the smallest of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        root = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(root, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(root.select("a", F.col("m").alias("b"))).distinct()
        now = checkpointed(small)
        was, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == was:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
