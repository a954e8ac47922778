"""Connected components of a table of links, by star operations on edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefeed.runtime import discard, materialize


def _lowest(edges: DataFrame) -> DataFrame:
    """Every (node, neighbour) in both directions with the least of node and neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low"))
    return both.join(least, "a").withColumn("low", F.least("a", "low"))


def _large_star(edges: DataFrame) -> DataFrame:
    links = _lowest(edges).where(F.col("b") > F.col("a"))
    return links.select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Needs a > b in every row."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    links = edges.join(least, "a")
    hung = links.where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return hung.unionByName(least.select("a", F.col("low").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; component is the least node.

    ``edges`` has columns a and b. Every round writes its edges to the shared
    folder, so lineage stays short and lost executors cost one round at most.
    No group of neighbours is ever gathered; a node linked with a third of all
    others is one pre-aggregated minimum and one join that can be split.
    """
    ordered = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    current = materialize(ordered.distinct(), "edges")
    before = None
    while (now := _state(current)) != before:
        before = now
        step = materialize(_small_star(_large_star(current).distinct()).distinct(), "edges")
        discard(current)
        current = step
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
