"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.shared import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for each node of ``edges`` (``a``, ``b``: long).

    Each round ties every node to the smallest node it knows, first its larger neighbours, then its smaller ones
    (large star, small star), until every node points to one root and no root points on. A node's minimum is combined
    before the shuffle, and edges only ever point to smaller nodes, so a node with very many neighbours does not gather
    them. Loops and repeated edges do no harm; nodes must not be null. Rounds grow with the logarithm of the largest
    component.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        larger = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = larger.filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .filter("u != v")
            .distinct()
        )
        now = stored(small)
        if _only_stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )


def _only_stars(edges: DataFrame) -> bool:
    """Whether each ``u`` has one ``v`` only and no ``v`` is a ``u``: then each ``v`` is its component's smallest node."""
    tails = edges.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("out"))
    heads = edges.select(F.col("v").alias("node")).distinct().withColumn("out", F.lit(1).cast("long"))
    return tails.unionByName(heads).groupBy("node").agg(F.sum("out").alias("n")).filter("n > 1").isEmpty()
