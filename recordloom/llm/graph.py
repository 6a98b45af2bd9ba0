"""Connected components by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.store import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (large) or smaller (small) neighbours and itself on its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    if large:  # settled, so that the join reads its sides straight from shuffles and the rows of a hub can be split
        least = settle(least).hint("merge")
    hung = both.join(least, "u")
    hung = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return hung.where("u > v").distinct()


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node hangs on one root, which hangs on nothing."""
    several = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    hanging = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
    return several.unionAll(hanging).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of `edges` (u, v): the smallest node reachable.

    Every alternation at least halves the depth of the trees, so that the steps grow with the
    logarithm of the longest path.  Each step's edges are settled in the shared folder, so that plans
    stay small; what is asked of them is only whether they are stars.
    """
    edges = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _is_forest(edges):
        edges = settle(_star(_star(edges, True), False))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
