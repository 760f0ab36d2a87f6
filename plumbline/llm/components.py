"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialise


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Links each neighbour of a node to the smallest of them: the larger ones, or the others and the node."""
    if larger:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    smallest = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = around.join(smallest, "u")
    if larger:
        found = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        found = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return found.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges (u, v)``; the root is the smallest node of its component.

    Alternates large and small stars until nothing changes, which takes about as many rounds as the
    logarithm of the longest path. Each round is written out; smallest neighbours are found by
    aggregates that combine before the shuffle, so a node may have any number of neighbours.
    """
    current = materialise(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "edges")
    state = None
    while True:
        seen = current.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")
        ).first()
        if tuple(seen) == state or not seen.n:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(seen)
        current = materialise(_star(materialise(_star(current, True), "large"), False), "small")
