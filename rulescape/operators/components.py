"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, write_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour.

    `edges` are `(larger, smaller)`, so a node's smaller neighbours, if any, are those of the edges it begins.
    """
    low = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
    return edges.join(low, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    ends = F.explode(F.array("a", "b")).alias("a")
    return edges.join(low, "a").select(ends, F.col("m").alias("b")).filter("a <> b").distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Every node hangs on exactly one root, and no root hangs on anything."""
    leaf, root = (F.struct(F.col(c).alias("name"), F.lit(n).alias("leaf")) for c, n in (("a", 1), ("b", 0)))
    roles = edges.select(F.explode(F.array(leaf, root)).alias("x")).select("x.*")
    return roles.groupBy("name").agg(F.sum("leaf").alias("up"), F.min("leaf").alias("least")).filter(
        "up > 1 OR (up > 0 AND least = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """`(name, root)` for every linked name; the root is the smallest name.

    `links` has two text columns `a, b`. A third of the links may share one name: both
    steps aggregate to a minimum first and join back, so no neighbourhood is gathered. Each step is
    written by itself: the driver plans six shuffles a round, none of them twice.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, seen = write_table(edges)
    if seen["rows"]:
        while not _is_star_forest(edges):
            edges = cut(_small_star(cut(_large_star(edges))))
    leaves = edges.select(F.col("a").alias("name"), F.col("b").alias("root"))
    return leaves.unionByName(edges.select(F.col("b").alias("name"), F.col("b").alias("root")).distinct())
