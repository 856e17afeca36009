"""Connected components of a link table, by alternating stars.

Every step is a grouped minimum and a join on a key; no step brings the links of
a node together in one task, so a node with many links is as good as any. Each
round is cut off by a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platenlog.plans.session import shared_folder


def components(links: DataFrame, tasks: int | None = None) -> DataFrame:
    """``node, root`` for every node with a link; root is the smallest node it reaches.

    ``links`` has two columns of one orderable type, without nulls; direction,
    repeats and links to itself do not matter. ``tasks``: what a step reads again is in so many
    partitions at most, where the caller knows how many its links are worth.
    """
    shared_folder(links.sparkSession)
    a, b = links.columns
    # Always from the larger node to the smaller.
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v"))
    edges = dealt(edges.distinct(), tasks).checkpoint()
    # A round more would be a plan more, so stars are told from the edges themselves.
    while not _are_stars(edges, tasks):
        edges = _small_star(_large_star(edges, tasks), tasks).checkpoint()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        dealt(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct(), tasks)
    )


def dealt(frame: DataFrame, tasks: int | None) -> DataFrame:
    """The rows in so many partitions at most, by merging those next to each other; no shuffle."""
    return frame if tasks is None else frame.coalesce(tasks)


def _are_stars(edges: DataFrame, tasks: int | None) -> bool:
    """Whether every node has one smaller neighbour and is nobody's, or is the smallest of its own."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return dealt(seen.where("up > 0 and up + down > 1"), tasks).isEmpty()


def _large_star(edges: DataFrame, tasks: int | None) -> DataFrame:
    """Every node hands its smallest neighbour (or itself) to its larger neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    handed = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return dealt(dealt(handed, tasks).distinct(), tasks)


def _small_star(edges: DataFrame, tasks: int | None) -> DataFrame:
    """Every node hands its smallest neighbour to itself and its other smaller neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = (
        edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return dealt(dealt(moved.unionByName(least.select("u", F.col("m").alias("v"))), tasks).distinct(), tasks)
