"""Connected components of links, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import staged


def component_labels(links: DataFrame, folder: str) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the smallest node of its component.

    Large-star and small-star rounds: every node hands its larger, then its smaller neighbours to the least one, until
    all links point at least nodes. The number of links never grows, a hub is a minimum that is aggregated before the
    shuffle, and rounds grow with the logarithm of the longest path. Each round is written to the shared folder.
    """
    edges = staged(links.filter("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
                   .distinct(), "round_0", folder)
    number = 0
    while not _stars(edges):
        number += 1
        both = edges.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(
            edges.select(F.col("low").alias("u"), F.col("high").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("high"),
                                            F.col("m").alias("low"))
        edges = staged(small.select("low", "high").distinct(), f"round_{number}", folder)
    tops = edges.select(F.col("low").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("high").alias("node"), F.col("low").alias("label")).unionByName(tops)


def _stars(edges: DataFrame) -> bool:
    """True if every node either has one smaller neighbour or only larger ones."""
    ends = edges.select(F.col("high").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("low").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter("up > 1 or (up = 1 and down = 1)").isEmpty()
