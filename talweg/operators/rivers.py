"""River networks, heads, divides and the chi coordinate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import GridSpec
from .accumulate import basins, distance_to_outlet
from .iterate import to_root
from .neighbours import neighbours


def river_nodes(sfd: DataFrame, area: DataFrame, threshold: float) -> DataFrame:
    """node, area of nodes that drain more than ``threshold`` (area grows downstream, so their paths are among them)."""
    return area.filter(F.col("value") > threshold).select("node", F.col("value").alias("area"))


def river_heads(sfd: DataFrame, area: DataFrame, threshold: float) -> DataFrame:
    """node of river nodes without a donor in the river."""
    river = river_nodes(sfd, area, threshold).select("node")
    fed = sfd.filter("node <> rec").join(river, "node", "left_semi").select(F.col("rec").alias("node")).distinct()
    return river.join(fed, "node", "left_anti")


def river_network(sfd: DataFrame, nodes: DataFrame, area: DataFrame, threshold: float) -> DataFrame:
    """node, receiver, basin, river, area, z, dx, flow_distance of every river node.

    A river is named by its head; where rivers meet, the one with the larger area goes on (ties: smaller node).
    """
    river = river_nodes(sfd, area, threshold)
    s = sfd.join(river, "node")
    donors = s.filter("node <> rec").groupBy(F.col("rec").alias("node")).agg(F.max(F.struct("area", (-F.col("node")).alias("m"))).alias("b"))
    main = s.select("node", "dx").join(donors, "node", "left").select("node", F.coalesce(-F.col("b.m"), F.col("node")).alias("rec"), F.lit(1.0).alias("dx"))
    head = to_root(main).select("node", F.col("root").alias("river"))
    out = s.select("node", F.col("rec").alias("receiver"), "area", "dx").join(head, "node").join(nodes.select("node", "z"), "node")
    out = out.join(basins(sfd).select("node", F.col("root").alias("basin")), "node").join(distance_to_outlet(sfd).withColumnRenamed("value", "flow_distance"), "node")
    return out.select("node", "receiver", "basin", "river", "area", "z", "dx", "flow_distance")


def divides(sfd: DataFrame, nodes: DataFrame, spec: GridSpec) -> DataFrame:
    """node, basin, z, other: a row for each neighbour that lies in another basin."""
    b = to_root(sfd).select("node", F.col("root").alias("basin"))
    e = neighbours(nodes.select("node", "z").join(b, "node"), spec, values=["z", "basin"])
    return e.filter("basin <> basin_nb").select("node", "basin", "z", F.col("nb").alias("other"))


def chi(sfd: DataFrame, area: DataFrame, a0: float = 1.0, theta: float = 0.2) -> DataFrame:
    """node, value: the sum of dx * (a0 / area)^theta down to the outlet."""
    s = sfd.join(area, "node").withColumn("_w", F.col("dx") * F.pow(F.lit(a0) / F.col("value"), F.lit(theta)))
    return to_root(s, F.col("_w")).select("node", F.col("length").alias("value"))


def river_profile(network: DataFrame, river: int) -> DataFrame:
    """The nodes of one river from its mouth up, with rank."""
    return network.filter(F.col("river") == river).selectExpr("row_number() over (order by flow_distance, node) as rank", "node", "z", "area", "flow_distance")
