"""Connected components over link tables, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut


def _star(both: DataFrame) -> DataFrame:
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the links (u, v): the smallest id that each reaches.

    Self links and repeated links change nothing, but a node with self links only isn't listed. Every round
    groups by minimum only (combined before the shuffle), so a hub costs no task more than its links read once;
    each round is a table of its own.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    edges, before = cut(edges), None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        edges = cut(small.filter("u > v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # a star: every node but the centres has one link, to its centre
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.selectExpr("u as node", "v as component").unionAll(centres)
