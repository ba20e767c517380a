"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` links to ``node, root``: each linked node with the smallest node of its component.

    That smallest node has no row itself. Links may point either way and repeat. Each round
    writes its links to the shared folder. The number of rounds grows with the logarithm of the
    component size.
    """
    links = settle(edges.where("u <> v").select("u", "v").distinct(), "links")
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    state = links.agg(F.count("*"), mark).first()
    while True:
        links = settle(_small_star(_large_star(links).distinct()).distinct(), "links")
        now = links.agg(F.count("*"), mark).first()
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
