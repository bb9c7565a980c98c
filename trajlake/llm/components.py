"""Connected components of a link table, by repeated contraction of trees of smaller neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.session import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """(v, root) for every node of ``links`` (columns a, b); root is one node of its component.

    Each round points every node to its smallest neighbour where that is smaller, follows the pointers to their
    ends by doubling, and keeps the links between different ends; nothing is gathered by node.
    """
    edges = cut_lineage(links.select("a", "b").filter(F.col("a") != F.col("b")).distinct())
    nodes = edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct()
    found = edges.select(F.col("a").alias("v"), F.col("b").alias("root")).limit(0)
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = forest_roots(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("root")).filter(F.col("root") < F.col("v")))
        found = cut_lineage(moved_on(found, ends).union(ends))
        at_a, at_b = ends.select(F.col("v").alias("a"), F.col("root").alias("ma")), ends.select(F.col("v").alias("b"), F.col("root").alias("mb"))
        moved = edges.join(at_a, "a", "left").join(at_b, "b", "left").select(F.coalesce("ma", "a").alias("x"), F.coalesce("mb", "b").alias("y"))
        edges = cut_lineage(moved.filter(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return nodes.join(found, "v", "left").select("v", F.coalesce("root", "v").alias("root"))


def moved_on(roots: DataFrame, further: DataFrame) -> DataFrame:
    """``roots`` (v, root) with each root replaced by its own root in ``further``."""
    onto = further.select(F.col("v").alias("root"), F.col("root").alias("_m"))
    return roots.join(onto, "root", "left").select("v", F.coalesce("_m", "root").alias("root"))


def forest_roots(parents: DataFrame) -> DataFrame:
    """(v, root) from (v, root) where each v has one, smaller parent: pointers double until none moves."""
    parents = cut_lineage(parents.select("v", "root"))
    while True:
        onto = parents.select(F.col("v").alias("root"), F.col("root").alias("_up"))
        stepped = cut_lineage(parents.join(onto, "root", "left").select("v", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")))
        parents = stepped.select("v", "root")
        if stepped.filter("moved").isEmpty():
            return parents
