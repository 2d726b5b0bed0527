"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.session import settle


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _distinct(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    around = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _distinct(around.union(least.select("u", F.col("m").alias("v"))))


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node in the two integer columns of ``links``.

    Alternates the large-star and small-star steps until every node hangs on its root; the number of rounds
    grows with the logarithm of the longest chain. Each round is stored, so none depends on executors of an
    earlier one. Links of a node to itself and repeated links change nothing, except that a node with no
    other link is not listed. An empty table has no components.
    """
    a, b = links.columns[:2]
    edges = settle(_distinct(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))))
    state = None
    while True:
        edges = settle(_small_star(_large_star(edges)))
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = tuple(seen)
