"""Connected components of a graph too large for one machine, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large: each node's greater neighbours go to the least of the node and its neighbours. Small: each node and
    its lesser neighbours go to the least of these. Both keep the components and shorten the paths."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_v")).select("_u", F.least("_u", "_v").alias("_m"))
    joined = both.join(least, F.col("u") == F.col("_u"))
    if large:
        return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_m").alias("v")).filter("u <> v").distinct()
    moved = joined.select(F.col("v").alias("u"), F.col("_m").alias("v"))
    own = least.select(F.col("_u").alias("u"), F.col("_m").alias("v"))
    return moved.unionByName(own).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b): (node, component) of every node with a link, component the least node that it reaches.
    Each round is written to the shared folder; rounds grow with the logarithm of the longest path."""
    greater, lesser = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = written(links.select(greater, lesser).filter("u <> v").distinct(), "links")
    state = None
    while True:
        now = written(_star(_star(now, True), False), "stars")
        # links between greater and lesser nodes are a star forest once a round changes nothing
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state:
            break
        state = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
