"""Connected components of a distributed edge table, by alternating stars.

Each round hangs every node's larger neighbours on its smallest neighbour (the
large star) and then the node and its smaller neighbours on the smallest (the
small star), until every edge leads to its component's smallest node.  Nodes
are never gathered by key: a round takes minima per node, which Spark combines
before the shuffle, and joins them back, which AQE splits for a hot node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inventra.llm.tables import dropped, stored


def _hung(edges: DataFrame, lowest: DataFrame) -> DataFrame:
    return edges.join(lowest, "u").select("u", "v", "m")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns a, b: longs) but the
    roots themselves; root is the smallest node reachable.  Null ends and loops
    are no edges."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _hung(both, lowest).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = _hung(large, lowest)
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        before, now = now, stored(small.where("u <> v").distinct())
        dropped(before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
