"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostgrid.llm.common import checkpointed, enough_tasks


def components(links: DataFrame) -> DataFrame:
    """The component of every node that occurs in ``links``.

    ``links`` has two columns of one type, ``a`` and ``b``; nulls and links of a
    node to itself are left out. Returns ``node`` and ``root``, the smallest
    node of its component; no links give no rows.

    Large-star and small-star steps alternate until all links lead to roots, about the
    logarithm of the longest path in number. Each step takes a minimum per
    node, combined before the shuffle, and joins it back, so the neighbours of
    a node never meet in one task's memory. Every step is checkpointed.
    """
    edges = checkpointed(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    parts = enough_tasks(edges.count())
    edges = edges.coalesce(parts)
    while not _is_star_forest(edges, parts):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = _to_smallest(both, both.where(F.col("v") > F.col("u")), parts)
        edges = checkpointed(_to_smallest(edges, edges, parts))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _is_star_forest(edges: DataFrame, parts: int) -> bool:
    """Whether every ``u`` has one ``v`` and no ``v`` is a ``u``: what the steps leave as it is, and all they leave so."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("below")).distinct().coalesce(parts)
    )
    # A root has one row, as has a node below a single root.
    counts = ends.groupBy("node").agg(F.sum("below").alias("below"), F.count("*").alias("rows"))
    return counts.where("below > 0 and rows > 1").coalesce(parts).isEmpty()


def _to_smallest(neighbours: DataFrame, moved: DataFrame, parts: int) -> DataFrame:
    """Link each node, and of its neighbours those in ``moved``, to the smallest of node and neighbours, in ``parts`` partitions."""
    least = neighbours.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    links = moved.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return links.unionByName(own).where(F.col("u") != F.col("v")).coalesce(parts).distinct().coalesce(parts)
