"""Connected components of a graph given by its links, as alternating large-star and
small-star rounds over tables of links: no task ever holds a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _state(links: DataFrame) -> tuple:
    """Tells whether two rounds left the same links."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node``, ``label``: each node of ``links`` (``a``, ``b``) with the smallest node that
    it is connected to. Self-links and repeats are allowed.

    A node's neighbours are never gathered: rounds use its smallest neighbour only (a
    partial aggregate) and join it back to the links, a join whose hot keys Spark splits.
    """
    links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = _state(links)
    while state[0]:
        near = _both_ways(links)
        # written, so that both sides of the join are plain shuffles, of which Spark splits hot nodes
        low = cut(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = near.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a")
        small = (small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        links = cut(small)
        last, state = state, _state(links)
        if state == last:
            break
    roots = links.select("b").distinct()
    return (links.select(F.col("a").alias("node"), F.col("b").alias("label"))
                 .unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("label"))))
