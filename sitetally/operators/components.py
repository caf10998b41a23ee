"""Connected components of a link table by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _hang(links: DataFrame, larger_only: bool) -> DataFrame:
    """Links from the members of each node's neighbourhood to its least one.

    ``larger_only`` looks both ways along a link and moves a node's larger neighbours; else a node's own smaller
    neighbours, and the node itself, are moved.
    """
    sides = links if not larger_only else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = sides.join(least, "a").where("b > a" if larger_only else "true").select(F.col("b").alias("a"), F.col("m").alias("b"))
    whole = moved if larger_only else moved.unionByName(least.select("a", F.col("m").alias("b")))
    return whole.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) to (node, root): the least node each one reaches; nodes without a link to another one are absent.

    Nodes are of any comparable type. Rounds grow with the logarithm of the longest chain.
    """
    links = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
        links = cut_lineage(_hang(_hang(links, True), False))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
