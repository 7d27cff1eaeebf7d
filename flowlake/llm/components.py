"""Connected components of a link table, by alternating large and small stars.

Each round replaces links by links to the smallest neighbour, first for the larger neighbours of a
node, then for the smaller ones, until all links point at their component's smallest node. Rounds
are joins and partial minima; the links are checkpointed after each, and only a count and a sum
of hashes come to the driver, to see whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import cut


def stars(links: DataFrame, large: bool) -> DataFrame:
    """One large or small star over links (a, b) with a > b."""
    both = links.union(links.select("b", "a"))
    near = both if large else links
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    tied = near.join(least, F.col("a") == F.col("u"))
    if large:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for every node of links (a, b)."""
    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda frame: frame.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    before = mark(links)
    while before[0]:
        links = cut(stars(stars(links, True), False))
        after = mark(links)
        if tuple(after) == tuple(before):
            break
        before = after
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
