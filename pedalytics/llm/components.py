"""Connected components of a graph given as edges, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedalytics.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns a, b: long), root the smallest node reachable.

    Alternating large-star and small-star steps: neighbours larger than a
    node are linked to its smallest neighbour, then the smaller ones are.
    Each round is written to the shared folder; it ends when every node hangs
    directly below a root, after about log2 of the longest chain.
    """
    links = materialize(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        links = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        deep = links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        if deep.isEmpty() and links.groupBy("a").count().filter("count > 1").isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
