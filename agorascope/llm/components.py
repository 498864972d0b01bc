"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorascope.llm.common import stable


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are hung on the smallest node of its neighbourhood, itself included."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are hung on the smallest of these neighbours."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    rest = down.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return rest.union(low.select("a", F.col("low").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node with an edge to a smaller one, the smallest node it can reach.

    ``edges`` has two long columns a and b. A root itself has no row. Stars of any size are built
    with pre-aggregated minima and plain joins, so no task holds a whole component; each round is
    written to the checkpoint folder and the loop ends when a round changes nothing.
    """
    now = stable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark or not row[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(row)
        now = stable(_small_star(_large_star(now).distinct()).distinct())
