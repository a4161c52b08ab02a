"""Connected components by alternating large-star and small-star.

Large-star links every larger neighbour of a node to the smallest node around it, small-star every smaller neighbour. Both
keep the components; alternated until nothing changes, they leave a star around the smallest node of each. A node's
neighbours never meet in one place: the minimum is an aggregate, and the join that hands it out can split a node's links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidetrace.llm.common import discard, written


def _hand_out(links: DataFrame, lowest: DataFrame) -> DataFrame:
    return links.join(written(lowest, "lowest"), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _hand_out(both, lowest).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger node ``u`` to the smaller ``v``."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    found = _hand_out(edges, lowest).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return found.where("u > v").distinct()


def _done(edges: DataFrame) -> bool:
    """Every node is on one side of the links only, and no larger node has two smaller ones."""
    twice = edges.groupBy("u").count().where("count > 1").select("u")
    middle = edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi")
    return twice.union(middle).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: of each node of an edge its component's smallest node, itself included.

    ``edges`` is (u, v) of any orderable type; order, repeats and loops don't matter, edges with a null are left out. A node
    without an edge to another one isn't in the result. Rounds grow with the logarithm of the longest path.
    """
    larger = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = written(larger.distinct(), "edges")
    while not _done(stars):
        large = written(_large_star(stars), "stars")
        small = written(_small_star(large), "stars")
        discard(stars, large)
        stars = small
    found = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    both = written(found.union(found.select("component", "component").distinct()), "components")
    discard(stars)
    return both


def extended(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``components`` of the edges that gave ``found`` and of more ``edges``."""
    edges = written(edges, "more")
    if edges.isEmpty():
        return found
    return components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(edges))
