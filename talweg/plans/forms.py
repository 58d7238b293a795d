"""Registered queries of the operators' further forms, over the same surface, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boundary as B
from ..functions.grid import GridSpec, distance, manhattan
from ..operators import accumulate as A
from ..operators import builder, depressions, distances, flow, graphs, hull, modularity, ranges, rivers, routes, shapes, terrain, traversal, voxels
from ..operators.iterate import to_root
from ..operators.neighbours import bit_code, effective_neighbours, extreme_neighbour, link_ends, links, neighbours, orthogonal
from ..scratch import cut, mounted_path
from ..sources import raster
from . import flood
from .queries import _AREA, _DOWN, _FACE, _FILL, _MFD, _VOX, EDGES, PATHS, ROOTS, SFD, _area, _scaled, _sql, _vox, query

_RIM = "(r IN (0, ny - 1) OR c IN (0, nx - 1))"


# boundary codes and node types

_PREDICATES = {
    "is_no_data": "b = 0", "is_normal": "b IN (1, 2)", "can_receive": "b NOT IN (0, 7, 8)", "can_give": "b NOT IN (0, 4, 5)",
    "can_out": "b IN (3, 4, 5)", "has_to_out": "b IN (4, 5)", "forces_giving": "b = 8", "forces_receiving": "b = 5",
    "is_inlet": "b IN (7, 8)", "is_periodic": "b = 9", "is_closed": "b = 6", "is_active": "b <> 0", "is_border": "b NOT IN (0, 1, 2)",
    "can_create_link": "b <> 0", "needs_care": "b <> 1",
}


@query(_sql("SELECT node, " + ", ".join(f"{s} AS {n}" for n, s in _PREDICATES.items()) + ", b <> 0 AS has_data FROM (SELECT node, node % 10 AS b FROM nodes)"))
def boundary_predicates(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    b = F.col("node") % 10
    return nodes.select("node", *[f(b).alias(n) for n, f in B.PREDICATES.items()], B.valid(b).alias("has_data"))


@query(_sql("SELECT node, ['NO_DATA','NORMAL','HAS_TO_OUT','CAN_OUT','IN','PERIODIC','REFLECT'][k + 1] AS name, k IN (2, 3) AS gives_out, k IN (1, 3, 4, 5) AS takes_in, k <> 0 AS active, k > 1 AS boundary FROM (SELECT node, node % 7 AS k FROM nodes)"))
def node_type_predicates(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    k = F.col("node") % 7
    return nodes.select("node", B.type_name(k).alias("name"), B.allows_outflow(k).alias("gives_out"), B.allows_inflow(k).alias("takes_in"), B.type_is_active(k).alias("active"), B.type_is_boundary(k).alias("boundary"))


@query(_sql("SELECT node, (c + 0.5::DOUBLE) * 30 + 100 AS x, (ny - r - 0.5::DOUBLE) * 20 + 50 AS y, node AS back FROM nodes, dims"))
def node_coordinates(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    s = GridSpec(spec.nx, spec.ny, 30.0, 20.0, 100.0, 50.0)
    xy = s.with_rowcol(nodes).select("node", s.x(F.col("c")).alias("x"), s.y(F.col("r")).alias("y"))
    return xy.withColumn("back", s.node_at(F.col("x"), F.col("y")))


@query(_sql("SELECT node, round(sqrt((r - 7) * (r - 7) + (c - 11) * (c - 11)), 6) AS straight, (abs(r - 7) + abs(c - 11))::DOUBLE AS manhattan FROM nodes"))
def distances_to_a_node(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    rc, at = spec.with_rowcol(nodes), (F.col("r"), F.col("c"), F.lit(7), F.lit(11))
    return rc.select("node", F.round(distance(spec, *at), 6).alias("straight"), manhattan(spec, *at).alias("manhattan"))


@query(_sql("SELECT node FROM nodes WHERE r BETWEEN 3 AND 9 AND c BETWEEN 5 AND 21"))
def nodes_in_a_rectangle(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return A.nodes_in_rectangle(nodes, spec, 9, 5, 3, 21)


@query(_sql("SELECT node, z > 3000000000 AS has_data FROM nodes"))
def valid_data_mask(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return A.recast_below(builder.codes(nodes, spec), 3_000_000_001).select("node", B.valid(F.col("bc")).alias("has_data"))


# neighbours and links


@query(_sql("SELECT node, sum(1 << dir)::BIGINT AS bits FROM edges WHERE z_nb < z GROUP BY node", EDGES))
def lower_neighbour_bits(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return bit_code(flow.downhill(nodes, spec)).select("node", F.col("bits").cast("long").alias("bits"))


@query(_sql("SELECT node, nb, z_nb AS z FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY z_nb DESC, nb) AS k FROM edges) WHERE k = 1", EDGES))
def highest_neighbour(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return extreme_neighbour(nodes, spec, highest=True)


@query(_sql("SELECT node * 4 + CASE dir WHEN 4 THEN 0 WHEN 7 THEN 1 WHEN 6 THEN 2 ELSE 3 END AS link, CASE WHEN z > z_nb THEN node ELSE nb END AS giver, CASE WHEN z > z_nb THEN nb ELSE node END AS taker FROM edges WHERE dir IN (4, 5, 6, 7)", EDGES))
def link_endpoints(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return link_ends(links(nodes, spec)).select("link", F.col("from").alias("giver"), F.col("to").alias("taker"))


@query(_sql("""SELECT e.node, e.dir::BIGINT AS dir, CASE WHEN e.r - e.dc BETWEEN 0 AND ny - 1 AND e.c + e.dr BETWEEN 0 AND nx - 1 THEN (e.r - e.dc) * nx + e.c + e.dr END AS one,
  CASE WHEN e.r + e.dc BETWEEN 0 AND ny - 1 AND e.c - e.dr BETWEEN 0 AND nx - 1 THEN (e.r + e.dc) * nx + e.c - e.dr END AS other FROM edges e, dims""", EDGES))
def orthogonal_cells(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    out = orthogonal(neighbours(nodes, spec), spec)
    return out.select("node", F.col("dir").cast("long").alias("dir"), F.col("left").alias("one"), F.col("right").alias("other"))


@query(_sql("""SELECT node, nb, round(dx, 6) AS dx, dir::BIGINT AS dir FROM edges UNION ALL
SELECT node, node, 0, dir::BIGINT FROM nodes, offs, dims WHERE NOT (r + dr BETWEEN 0 AND ny - 1 AND c + dc BETWEEN 0 AND nx - 1)""", EDGES))
def reflecting_neighbours(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    out = effective_neighbours(builder.preset(nodes, spec, "closed"), spec)
    return out.select("node", "nb", F.round("dx", 6).alias("dx"), F.col("dir").cast("long").alias("dir"))


# flow


@query(_sql("SELECT node, nb, round(greatest(slope / 1e6, 10), 6) AS gradient FROM down", EDGES, _DOWN))
def link_gradients(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    e = flow.downhill(nodes, spec).withColumn("slope", F.col("slope") / 1e6)
    return flow.link_gradient(e, 10.0).select("node", "nb", F.round("gradient", 6).alias("gradient"))


@query(_sql(f"SELECT n.node, count(e.nb) AS n FROM nodes n LEFT JOIN (SELECT edges.* FROM edges, dims WHERE NOT {_RIM}) e ON e.node = n.node GROUP BY n.node", EDGES))
def potential_receiver_counts(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return flow.potential_receivers(builder.codes(nodes, spec), spec)


@query(_sql("SELECT n.node, count(d.nb) AS n FROM nodes n LEFT JOIN down d ON d.nb = n.node GROUP BY n.node", EDGES, _DOWN))
def mfd_donor_counts(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return flow.donor_counts(nodes, flow.downhill(nodes, spec))


@query(_sql("SELECT node, round(max(slope) / 1e6, 6) AS slope FROM (SELECT node, slope FROM down UNION ALL SELECT nb, slope FROM down) GROUP BY node", EDGES, _DOWN))
def largest_link_slope(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return flow.max_link_value(flow.downhill(nodes, spec), "slope").select("node", F.round(F.col("slope") / 1e6, 6).alias("slope"))


@query(_sql("SELECT n.node, coalesce(b.nb, n.node) AS rec FROM nodes n LEFT JOIN (SELECT node, nb, row_number() OVER (PARTITION BY node ORDER BY nb % 13 DESC, nb) AS k FROM down) b ON b.node = n.node AND k = 1", EDGES, _DOWN))
def receiver_by_discharge(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return flow.by_discharge(nodes.withColumn("q", F.col("node") % 13), spec, "q").select("node", "rec")


@query(_sql("SELECT node, nb, round(w / sum(w) OVER (PARTITION BY node), 6) AS weight FROM (SELECT *, sqrt(slope / 1e6) * CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2) ELSE 1 END AS w FROM down)", EDGES, _DOWN))
def hydraulic_weights_sqrt(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    e = flow.downhill(nodes, spec).withColumn("slope", F.col("slope") / 1e6)
    return flow.hydraulic_weights(e, spec, "sqrt").select("node", "nb", F.round("weight", 6).alias("weight"))


@query(_sql("SELECT node, round(sum(slope * slope) / sum(slope) / 1e6, 4) AS gradient FROM down GROUP BY node", EDGES, _DOWN))
def weighted_gradient(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    e = flow.downhill(nodes, spec).withColumn("w", F.col("slope") / 1e6)
    return flow.mean_gradient(e, "w").select("node", F.round(F.col("gradient") / 1e6, 4).alias("gradient"))


@query(_sql(f"SELECT node FROM sfd JOIN nodes USING (node), dims WHERE rec = node AND {_RIM}", EDGES, SFD))
def outlet_nodes(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return flow.outlets(flow.steepest(nodes, spec), builder.codes(nodes, spec))


# accumulation, paths and masks


@query(_sql("SELECT node, CASE WHEN rec = node THEN value ELSE 0 END AS value FROM area JOIN sfd USING (node)", EDGES, SFD, PATHS, _AREA))
def values_at_outlets(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return A.keep_at_outlets(*_area(nodes, spec))


@query(_sql("SELECT node, value - 1 AS value FROM area", EDGES, SFD, PATHS, _AREA))
def flow_counts(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return A.flow_count(cut(flow.steepest(nodes, spec)))


@query(_sql("SELECT p.node, max(n.z) AS value FROM paths p JOIN nodes n ON n.node = p.src GROUP BY p.node", EDGES, SFD, PATHS))
def highest_upstream(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return A.extreme_upstream(cut(flow.steepest(nodes, spec)), nodes.select("node", F.col("z").alias("value")))


@query(_sql("SELECT p.node, min(n.z % 1000) AS value FROM paths p JOIN nodes n ON n.node = p.src GROUP BY p.node", EDGES, SFD, PATHS))
def least_upstream(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return A.extreme_upstream(cut(flow.steepest(nodes, spec)), nodes.select("node", (F.col("z") % 1000).alias("value")), False)


_LOSS = _MFD.replace("s.value * w.weight", "s.value * w.weight * 0.9")


@query(_sql("SELECT node, round(sum(value), 6) AS value FROM sent GROUP BY node", EDGES, _DOWN, _LOSS))
def mfd_with_loss(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    e = cut(flow.partition(flow.downhill(nodes, spec), "freeman"))
    start = nodes.select("node", F.lit(1.0).alias("value"))
    return A.with_loss(e, start, None, 0.1, spec).select("node", F.round("value", 6).alias("value"))


_RAIN = _MFD.replace("SELECT node, node, 1::DOUBLE FROM nodes", "SELECT node, node, (node % 3) * 0.5::DOUBLE FROM nodes")


@query(_sql("SELECT node, round(sum(value), 6) AS value FROM sent GROUP BY node", EDGES, _DOWN, _RAIN))
def rain_discharge(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    e = cut(flow.partition(flow.downhill(nodes, spec), "freeman"))
    rain = nodes.select("node", ((F.col("node") % 3) * 0.5).alias("value"))
    return A.discharge(e, rain, None, spec).select("node", F.round("value", 6).alias("value"))


def _to_outlets(f: str) -> str:
    return _sql(f"SELECT node, round({f}(length), 6) AS value FROM walk GROUP BY node", EDGES, _DOWN, "walk(node, length) AS (SELECT node, 0::DOUBLE FROM nodes WHERE node NOT IN (SELECT node FROM down) UNION SELECT d.node, w.length + d.dx FROM walk w JOIN down d ON d.nb = w.node)")


@query(_to_outlets("max"))
def max_distance_to_outlets_mfd(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return A.mfd_distance(cut(flow.downhill(nodes, spec)), nodes, True, False, spec=spec).select("node", F.round("value", 6).alias("value"))


@query(_to_outlets("min"))
def min_distance_to_outlets_mfd(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return A.mfd_distance(cut(flow.downhill(nodes, spec)), nodes, False, False, spec=spec).select("node", F.round("value", 6).alias("value"))


_BIG = "big AS MATERIALIZED (SELECT node FROM area ORDER BY value DESC, node LIMIT 1)"


@query(_sql("SELECT p.src AS node FROM paths p, big WHERE p.node = big.node", EDGES, SFD, PATHS, _AREA, _BIG))
def watershed_of_an_outlet(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    sfd, area = _area(nodes, spec)
    return A.watershed(A.as_edges(sfd), area.orderBy(F.col("value").desc(), "node").limit(1).select("node")).select("node")


@query(_sql("SELECT n.node, CASE WHEN w.src IS NULL THEN 0 WHEN n.node = big.node THEN 4 WHEN " + _RIM + " THEN 4 ELSE 1 END::TINYINT AS bc FROM dims, big, nodes n LEFT JOIN (SELECT p.src FROM paths p, big WHERE p.node = big.node) w ON w.src = n.node", EDGES, SFD, PATHS, _AREA, _BIG))
def recast_upstream_of_an_outlet(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    sfd, area = _area(nodes, spec)
    top = area.orderBy(F.col("value").desc(), "node").first()["node"]
    return A.only_upstream_of(builder.codes(nodes, spec), A.as_edges(sfd), top).select("node", "bc")


_CLIMB = "low AS MATERIALIZED (SELECT node FROM nodes ORDER BY z DESC, node OFFSET 40 LIMIT 5), climb(node) AS (SELECT node FROM low UNION SELECT e.nb FROM climb k JOIN edges e ON e.node = k.node WHERE e.z_nb >= e.z)"


@query(_sql("SELECT node FROM climb", EDGES, _CLIMB))
def upstream_by_elevation(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    starts = nodes.orderBy(F.col("z").desc(), "node").offset(40).limit(5).select("node")
    return A.upstream_by_elevation(nodes, spec, starts).select("node")


_INSIDE = "inside AS MATERIALIZED (SELECT s.node, CASE WHEN b.z > 4000000000 THEN s.rec ELSE s.node END AS rec FROM sfd s JOIN nodes a ON a.node = s.node JOIN nodes b ON b.node = s.rec WHERE a.z > 4000000000), ipaths(src, node) AS (SELECT node, node FROM inside UNION ALL SELECT p.src, s.rec FROM ipaths p JOIN inside s ON s.node = p.node WHERE s.rec <> s.node)"


@query(_sql("SELECT p.src AS node, p.node AS root FROM ipaths p JOIN inside s ON s.node = p.node WHERE s.rec = s.node", EDGES, SFD, _INSIDE))
def basins_within_a_mask(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return A.basins_in_mask(cut(flow.steepest(nodes, spec)), nodes.select("node", (F.col("z") > 4_000_000_000).alias("mask")))


@query(_sql("SELECT n.node, CASE WHEN n.z <= 4000000000 THEN 0 WHEN count(e.nb) < 8 THEN 3 ELSE 1 END::TINYINT AS bc FROM nodes n LEFT JOIN edges e ON e.node = n.node AND e.z_nb > 4000000000 GROUP BY n.node, n.z", EDGES))
def boundaries_of_a_mask(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return A.boundaries_of_mask(nodes, nodes.select("node", (F.col("z") > 4_000_000_000).alias("mask")), spec)


@query(_sql(f"SELECT n.node, CASE WHEN z <= 2000000000 THEN 0 WHEN node IN (SELECT node FROM edges WHERE z_nb <= 2000000000) THEN 3 WHEN {_RIM} THEN 4 ELSE 1 END::TINYINT AS bc FROM nodes n, dims", EDGES))
def seas_removed(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return A.remove_seas(builder.codes(nodes, spec), spec, 2e9).select("node", "bc")


_HAND = """stop AS MATERIALIZED (SELECT node FROM area WHERE value >= 5),
hp(src, node, height, length) AS (SELECT node, node, 0::DOUBLE, 0::DOUBLE FROM nodes UNION ALL
  SELECT p.src, s.rec, p.height + greatest(a.z - b.z, 0) / 1e6, p.length + s.dx FROM hp p JOIN sfd s ON s.node = p.node JOIN nodes a ON a.node = s.node JOIN nodes b ON b.node = s.rec
  WHERE s.rec <> s.node AND p.node NOT IN (SELECT node FROM stop))"""


@query(_sql("SELECT n.node, p.node AS target, round(p.height, 3) AS height, round(p.length, 6) AS length FROM nodes n LEFT JOIN (SELECT hp.* FROM hp JOIN stop ON stop.node = hp.node) p ON p.src = n.node", EDGES, SFD, PATHS, _AREA, _HAND))
def height_above_drainage(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    sfd, area = _area(nodes, spec)
    out = A.height_above(sfd, _scaled(nodes), A.mask_by_area(area, 5))
    return out.select("node", "target", F.round("height", 3).alias("height"), F.round("length", 6).alias("length"))


# depressions


@query(_sql("SELECT count(*) AS n, count(*) FILTER (v > z) AS n_filled, sum(v - z)::BIGINT AS volume, max(v - z) AS deepest FROM nodes JOIN fill USING (node)", EDGES, _FILL))
def flood_statistics(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    out = depressions.flood_report(depressions.fill(nodes, spec))
    return out.select("n", "n_filled", F.col("volume").cast("long").alias("volume"), F.col("deepest").cast("long").alias("deepest"))


@query(_sql("SELECT node, v AS filled FROM fill", EDGES, _FILL))
def reconstructed_surface(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return depressions.fill_by_relaxation(nodes, spec).select("node", F.col("filled").cast("long").alias("filled"))


@query(_sql("SELECT n.node, l.lake AS depression FROM nodes n LEFT JOIN (SELECT node, min(lake) AS lake FROM lakes GROUP BY node) l USING (node)", EDGES, _FILL, "under AS MATERIALIZED (SELECT node, v FROM fill JOIN nodes USING (node) WHERE v > z), lakes(node, lake) AS (SELECT node, node FROM under UNION SELECT e.nb, l.lake FROM lakes l JOIN edges e ON e.node = l.node JOIN under a ON a.node = e.node JOIN under b ON b.node = e.nb WHERE a.v = b.v)"))
def depression_labels(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return traversal.label_depressions(depressions.fill(nodes, spec), spec)


@query(_sql("SELECT p.src AS node, max(n.z)::DOUBLE AS raised FROM paths p JOIN nodes n ON n.node = p.node GROUP BY p.src", EDGES, SFD, PATHS))
def raised_to_receivers(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return depressions.raise_to_receivers(nodes, cut(flow.steepest(nodes, spec))).select("node", "raised")


@query(_sql("SELECT p.src AS node, p.hops::BIGINT AS level FROM paths p JOIN sfd s ON s.node = p.node WHERE s.rec = s.node", EDGES, SFD, PATHS))
def sfd_order(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return traversal.sfd_order(cut(flow.steepest(nodes, spec))).select("node", F.col("level").cast("long").alias("level"))


@query(_sql("SELECT node, greatest(abs(r - ny // 2), abs(c - nx // 2)) AS step FROM nodes, dims"))
def breadth_first_steps(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    out = traversal.breadth_first(nodes, spec, (spec.ny // 2) * spec.nx + spec.nx // 2)
    return out.select("node", F.col("step").cast("long").alias("step"))


# boundary builder


def _typed(expression: str) -> str:
    return _sql(f"SELECT node, {expression}::TINYINT AS node_type FROM nodes, dims", EDGES)


def _types(out: DataFrame) -> DataFrame:
    return out.select("node", "node_type")


@query(_typed("CASE WHEN node IN (SELECT node FROM nodes ORDER BY z DESC, node DESC LIMIT 10) THEN 4 ELSE 1 END"))
def highest_inlets(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _types(builder.mark_extremes(builder.filled(nodes), 10, highest=True))


@query(_typed("CASE WHEN z >= 12000000000 THEN 6 ELSE 1 END"))
def ridge_types(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _types(builder.ridges(builder.filled(nodes), 12e9))


@query(_typed(f"CASE WHEN NOT {_RIM} AND node NOT IN (SELECT node FROM edges WHERE z_nb < z + 5000000) THEN 2 ELSE 1 END"))
def valley_types(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _types(builder.valleys(builder.filled(nodes), spec, 5e6))


@query(_typed("CASE WHEN abs(r - 10) + abs(c - 14) <= 7 THEN 1 ELSE 0 END"))
def diamond_mask(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _types(builder.mask(builder.filled(nodes), builder.diamond(spec, 10, 14, 7)))


@query(_typed("CASE WHEN r BETWEEN 2 AND 12 AND c BETWEEN 3 AND 19 THEN 1 ELSE 0 END"))
def rectangle_mask(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _types(builder.mask(builder.filled(nodes), builder.rectangle(spec, 2, 3, 12, 19)))


@query(_typed("CASE WHEN (r - 6) * (r - 6) + (c - 8) * (c - 8) <= 16 OR (r - 15) * (r - 15) + (c - 25) * (c - 25) <= 16 THEN 1 ELSE 0 END"))
def island_mask(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _types(builder.mask(builder.filled(nodes), builder.islands(spec, [(6, 8), (15, 25)], 4.0)))


@query(_typed(f"CASE WHEN z <= 2000000000 THEN 0 WHEN {_RIM} OR node IN (SELECT node FROM edges WHERE z_nb <= 2000000000) THEN 3 ELSE 1 END"))
def fixed_borders(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _types(builder.fix_borders(cut(builder.set_where(builder.filled(nodes), F.col("z") <= 2e9, B.NO_DATA)), spec))


@query(_typed("CASE WHEN z <= 2000000000 OR node IN (SELECT node FROM edges WHERE z_nb <= 2000000000) THEN 6 ELSE 1 END"))
def expanded_type(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _types(builder.expand(cut(builder.set_where(builder.filled(nodes), F.col("z") <= 2e9, B.REFLECT)), spec, B.REFLECT))


@query(_typed("CASE WHEN (r - 4) * (r - 4) + (c - 4) * (c - 4) <= 9 OR (r - 0) * (r - 0) + (c - 20) * (c - 20) <= 9 THEN 2 ELSE 1 END"))
def types_near_points(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    points = nodes.sparkSession.createDataFrame([(4, 4), (0, 20)], "r long, c long")
    return _types(builder.near_points(builder.filled(nodes), spec, points, 3.0, B.HAS_TO_OUT))


@query(_typed("CASE WHEN z BETWEEN 2000000000 AND 6000000000 THEN 5 ELSE 1 END"))
def types_by_elevation_range(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _types(builder.elevation_range(builder.filled(nodes), 2e9, 6e9, B.PERIODIC))


@query(_sql("SELECT n.node, CASE WHEN a.value > 8 AND s.rec = s.node THEN 2 ELSE 1 END::TINYINT AS node_type FROM nodes n JOIN area a USING (node) JOIN sfd s USING (node)", EDGES, SFD, PATHS, _AREA))
def river_end_types(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    sfd, area = _area(nodes, spec)
    return _types(builder.river_system(builder.filled(nodes), rivers.river_network(sfd, nodes, area, 8)))


@query(_sql(f"""SELECT n.node, CASE WHEN NOT {_RIM} AND z <= 8000000000 AND high > k - high + 2 THEN 6 WHEN NOT {_RIM} AND z > 8000000000 AND k - high > high + 2 THEN 1
  WHEN z > 8000000000 THEN 6 ELSE 1 END::TINYINT AS node_type
  FROM dims, nodes n JOIN (SELECT node, count(*) AS k, count(*) FILTER (z_nb > 8000000000) AS high FROM edges GROUP BY node) m USING (node)""", EDGES))
def smoothed_types(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _types(builder.smooth(cut(builder.set_where(builder.filled(nodes), F.col("z") > 8e9, B.REFLECT)), spec))


_PRESETS = {
    "open": f"CASE WHEN {_RIM} THEN 3 ELSE 1 END",
    "closed": f"CASE WHEN {_RIM} THEN 6 ELSE 1 END",
    "periodic_ew": "CASE WHEN r IN (0, ny - 1) THEN 3 WHEN c IN (0, nx - 1) THEN 5 ELSE 1 END",
    "periodic_ns": "CASE WHEN c IN (0, nx - 1) THEN 3 WHEN r IN (0, ny - 1) THEN 5 ELSE 1 END",
    "periodic_ew_closed": "CASE WHEN r IN (0, ny - 1) THEN 6 WHEN c IN (0, nx - 1) THEN 5 ELSE 1 END",
    "periodic_ns_closed": "CASE WHEN c IN (0, nx - 1) THEN 6 WHEN r IN (0, ny - 1) THEN 5 ELSE 1 END",
    "inlet_outlet": "CASE WHEN r = ny - 1 THEN 2 WHEN r = 0 THEN 4 WHEN c IN (0, nx - 1) THEN 6 ELSE 1 END",
    "corners": f"CASE WHEN r IN (0, ny - 1) AND c IN (0, nx - 1) THEN 2 WHEN {_RIM} THEN 6 ELSE 1 END",
    "centre": f"CASE WHEN node = (ny // 2) * nx + nx // 2 THEN 2 WHEN {_RIM} THEN 6 ELSE 1 END",
}


@query(_sql(" UNION ALL ".join(f"SELECT '{n}' AS preset, node, ({s})::TINYINT AS node_type FROM nodes, dims" for n, s in _PRESETS.items())))
def boundary_presets(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    out = None
    for n in _PRESETS:
        one = builder.preset(nodes, spec, n).select(F.lit(n).alias("preset"), "node", "node_type")
        out = one if out is None else out.unionAll(one)
    return out


# terrain


@query(_sql("SELECT n.node, round(coalesce(d.v, 0), 4) AS value FROM nodes n LEFT JOIN (SELECT node, sum(slope / 1e6) * count(*) * count(*) AS v FROM down GROUP BY node) d USING (node)", EDGES, _DOWN))
def drainage_density_score(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return terrain.drainage_density(_scaled(nodes), spec).select("node", F.round("density", 4).alias("value"))


@query(_sql("SELECT node, CASE WHEN s < 60 THEN 'flat' WHEN s < 75 THEN 'slope' ELSE 'cliff' END AS terrain FROM (SELECT node, degrees(atan(max(abs(z_nb - z) / 1e9 / dx))) AS s FROM edges GROUP BY node)", EDGES))
def terrain_classes(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return terrain.terrain_class(terrain.slope(nodes.withColumn("z", F.col("z") / 1e9), spec), 60, 75).select("node", "terrain")


def _shade(azimuth: float) -> str:
    sun = (360 - azimuth + 90) % 360
    return f"greatest(0, cos(radians(45::DOUBLE)) * cos(steep) + sin(radians(45::DOUBLE)) * sin(steep) * cos(radians({sun}::DOUBLE) - facing))"


@query(_sql("SELECT node, CASE WHEN k < 8 THEN 0 ELSE round((" + " + ".join(_shade(a) for a in (225, 270, 315, 360)) + """) / 4, 6) END AS shade FROM (
  SELECT node, k, atan(sqrt(gx * gx + gy * gy)) AS steep, atan2(gy, -gx) AS facing FROM (SELECT node, count(*) AS k,
    sum(CASE dir WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 7 THEN 1 WHEN 0 THEN -1 WHEN 3 THEN -2 WHEN 5 THEN -1 ELSE 0 END * (z_nb / 1e9)) / 8 AS gx,
    sum(CASE dir WHEN 5 THEN 1 WHEN 6 THEN 2 WHEN 7 THEN 1 WHEN 0 THEN -1 WHEN 1 THEN -2 WHEN 2 THEN -1 ELSE 0 END * (z_nb / 1e9)) / 8 AS gy
  FROM edges GROUP BY node))""", EDGES))
def multi_angle_hillshade(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return terrain.multi_hillshade(nodes.withColumn("z", F.col("z") / 1e9), spec).select("node", F.round("shade", 6).alias("shade"))


@query(_sql("SELECT node, coalesce(max(top) OVER (PARTITION BY c - r ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > top, false) AS bottomright, coalesce(max(top) OVER (PARTITION BY c + r ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > top, false) AS bottomleft FROM (SELECT *, z + r * (sqrt(2::DOUBLE) * 1000000) AS top FROM nodes)"))
def cast_shadow_diagonals(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    one = terrain.cast_shadow(nodes, spec, "bottomright", 1_000_000).withColumnRenamed("shadow", "bottomright")
    return one.join(terrain.cast_shadow(nodes, spec, "bottomleft", 1_000_000).withColumnRenamed("shadow", "bottomleft"), "node")


def _gauss(value: str, by: str, order: str) -> str:
    w = f"OVER (PARTITION BY {by} ORDER BY {order})"
    near = [f"{f}({value}) {w}" for f in ("lag", "lead")]
    top = " + ".join([value, *[f"coalesce({x}, 0) * exp(-2.0::DOUBLE)" for x in near]])
    return f"({top}) / (1 + exp(-2.0::DOUBLE) * (" + " + ".join(f"CASE WHEN {x} IS NULL THEN 0 ELSE 1 END" for x in near) + "))"


@query(_sql(f"SELECT node, round({_gauss('v', 'c', 'r')}, 2) AS value FROM (SELECT node, r, c, {_gauss('(z / 1e6)', 'r', 'c')} AS v FROM nodes)"))
def gaussian_blur(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return terrain.blur(_scaled(nodes), spec, 1).select("node", F.round("z", 2).alias("value"))


# graphs

@query(_sql("SELECT round(-regr_slope(ln(boxes), ln(size)), 6) AS dimension FROM (SELECT s AS size, count(DISTINCT floor(r / s) * 1000000 + floor(c / s)) AS boxes FROM nodes, (VALUES (1), (2), (4), (8), (16)) v(s) WHERE z > 10000000000 GROUP BY s)"))
def box_dimension(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return graphs.box_dimension(nodes.filter(F.col("z") > 10_000_000_000), spec).select(F.round("dimension", 6).alias("dimension"))


@query(_sql("SELECT node FROM nodes WHERE node NOT IN (SELECT node FROM down)", EDGES, _DOWN))
def graph_sinks(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return graphs.sink_nodes(nodes, flow.downhill(nodes, spec))


# flooding


_WATER = "bed AS MATERIALIZED (SELECT node, z / 1e9 AS z, (node % 5) / 10.0::DOUBLE AS h FROM nodes), surf AS MATERIALIZED (SELECT e.node, e.nb, ((a.z + a.h) - (b.z + b.h)) / e.dx AS slope FROM edges e JOIN bed a ON a.node = e.node JOIN bed b ON b.node = e.nb WHERE a.z + a.h > b.z + b.h)"


def _water(nodes: DataFrame, spec: GridSpec) -> tuple[DataFrame, DataFrame]:
    wet = nodes.select("node", (F.col("z") / 1e9).alias("z"), ((F.col("node") % 5) / 10.0).alias("h"))
    return wet, flow.downhill(wet.select("node", (F.col("z") + F.col("h")).alias("z")), spec)


@query(_sql("SELECT node, round(h ** (2 / 3::DOUBLE) * sqrt(s) / 0.033, 6) AS u, round(h * h ** (2 / 3::DOUBLE) * sqrt(s) / 0.033, 6) AS q_unit, ways FROM (SELECT bed.node, h, coalesce(max(slope), 0) AS s, count(slope) AS ways FROM bed LEFT JOIN surf ON surf.node = bed.node GROUP BY bed.node, h)", EDGES, _WATER))
def hydraulic_metrics(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    m = flood.metrics(*_water(nodes, spec), spec)
    return m.select("node", F.round("u", 6).alias("u"), F.round("q_unit", 6).alias("q_unit"), F.col("ways").cast("long").alias("ways"))


@query(_sql("SELECT node, round(tau, 4) AS tau, round(CASE WHEN tau > 4 THEN 1e-5 * (tau - 4) ** 1.5 ELSE 0 END, 4) AS erosion FROM (SELECT bed.node, 1000.0::DOUBLE * 9.81 * h * coalesce(max(slope), 0) AS tau FROM bed LEFT JOIN surf ON surf.node = bed.node GROUP BY bed.node, h)", EDGES, _WATER))
def shear_stress_erosion(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    e = flood.shear_erosion(*_water(nodes, spec))
    return e.select("node", F.round("tau", 4).alias("tau"), F.round("erosion", 4).alias("erosion"))


@query(_sql("SELECT node, round(((node % 17) * 0.033 / (2 * sqrt(greatest((node % 5) / 100.0::DOUBLE, 1e-9)))) ** 0.6, 6) AS h FROM nodes"))
def analytical_depths(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return nodes.select("node", F.round(flood.analytical_depth((F.col("node") % 17).cast("double"), 2.0, (F.col("node") % 5) / 100.0), 6).alias("h"))


@query(_sql("""SELECT n.node, round(greatest(n.h + 0.05 * (coalesce(l.d, 0) + 0.001), 0), 6) AS h FROM bed n LEFT JOIN (
  SELECT node, sum(d) AS d FROM (SELECT node, -q AS d FROM lk UNION ALL SELECT nb, q FROM lk) GROUP BY node) l ON l.node = n.node""", EDGES, _WATER,
  "ends AS MATERIALIZED (SELECT e.node, e.nb, greatest(a.z + a.h, b.z + b.h) - greatest(a.z, b.z) AS depth, (b.z + b.h) - (a.z + a.h) AS fall, ((e.node % 9) - 4) / 10.0::DOUBLE AS q FROM edges e JOIN bed a ON a.node = e.node JOIN bed b ON b.node = e.nb WHERE e.dir IN (4, 6))",
  "lk AS MATERIALIZED (SELECT node, nb, CASE WHEN depth > 0 THEN (q - 9.81 * depth * 0.05 * fall) / (1 + 9.81 * 0.05 * 0.033 * 0.033 * abs(q) / depth ** (7 / 3::DOUBLE)) ELSE 0 END AS q FROM ends)"))
def inertial_flood_with_flux(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    wet, _ = _water(nodes, spec)
    e = neighbours(wet, spec).filter("dir in (4, 6)").select("node", "nb", ((F.col("node") % 9 - 4) / 10.0).alias("q"))
    return flood.inertial_step(wet, e, spec, 0.05, rain=0.001)[0].select("node", F.round("h", 6).alias("h"))


# voxels


def _place(out: DataFrame, *more: str) -> DataFrame:
    return out.select("x", "y", "z", *more)


def _value(out: DataFrame, digits: int = 6) -> DataFrame:
    return out.select("x", "y", "z", F.round("value", digits).alias("value"))


_BALL = "ball AS MATERIALIZED (SELECT a, b, d, (a * a + b * b + d * d)::DOUBLE AS far FROM (VALUES (-1), (0), (1)) i(a), (VALUES (-1), (0), (1)) j(b), (VALUES (-1), (0), (1)) k(d) WHERE a <> 0 OR b <> 0 OR d <> 0)"
_NEAR = "nearby AS MATERIALIZED (SELECT v.*, w.value AS v_n, far FROM vox v CROSS JOIN ball JOIN vox w ON w.x = v.x + a AND w.y = v.y + b AND w.z = v.z + d)"


def _counts(most: int) -> str:
    return f"SELECT v.x, v.y, v.z, count(w.x) AS n FROM vox v CROSS JOIN ball LEFT JOIN vox w ON w.x = v.x + a AND w.y = v.y + b AND w.z = v.z + d WHERE far <= {most} GROUP BY ALL"


@query(_sql(_counts(2), _VOX, _BALL))
def voxel_neighbours_18(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return voxels.neighbour_count(_vox(nodes, spec), 18)


@query(_sql(_counts(3), _VOX, _BALL))
def voxel_neighbours_26(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return voxels.neighbour_count(_vox(nodes, spec), 26)


@query(_sql(f"SELECT x, y, z FROM ({_counts(1)}) WHERE n < 6", _VOX, _BALL))
def voxel_surface(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _place(voxels.surface(_vox(nodes, spec)))


@query(_sql(f"SELECT x, y, z FROM ({_counts(3)}) WHERE n >= 26", _VOX, _BALL))
def voxel_interior_26(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _place(voxels.interior(_vox(nodes, spec), 26))


@query(_sql("SELECT x, y, z, round((value + s) / (1 + w), 4) AS value FROM (SELECT v.x, v.y, v.z, v.value, coalesce(sum(v_n * exp(-far / 2)), 0) AS s, coalesce(sum(exp(-far / 2)), 0) AS w FROM vox v LEFT JOIN nearby USING (x, y, z) GROUP BY ALL)", _VOX, _BALL, _NEAR))
def voxel_gaussian(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _value(voxels.gaussian(_vox(nodes, spec)), 4)


@query(_sql("SELECT x, y, z, round((value + s) / (1 + w), 4) AS value FROM (SELECT v.x, v.y, v.z, v.value, coalesce(sum(v_n * k), 0) AS s, coalesce(sum(k), 0) AS w FROM vox v LEFT JOIN (SELECT x, y, z, v_n, exp(-far / 2 - (v_n - value) * (v_n - value) / 2000000) AS k FROM nearby) USING (x, y, z) GROUP BY ALL)", _VOX, _BALL, _NEAR))
def voxel_bilateral(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _value(voxels.bilateral(_vox(nodes, spec), 1.0, 1000.0), 4)


@query(_sql("SELECT x, y, z, round(2 * median(v), 6) AS value FROM (SELECT x, y, z, v_n AS v FROM nearby UNION ALL SELECT x, y, z, value FROM vox) GROUP BY ALL", _VOX, _BALL, _NEAR))
def voxel_median(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _value(voxels.median(_vox(nodes, spec)).withColumn("value", F.col("value") * 2))


@query(_sql("SELECT x + 3 AS x, 2 * 50 - y * 2 AS y, z * 2 - 1 AS z FROM (SELECT x * 2 AS x, y, z FROM vox)", _VOX))
def voxel_transforms(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _place(voxels.translate(voxels.mirror(voxels.scale(_vox(nodes, spec), 2), "y", 50), (3, 0, -1)))


@query(_sql("SELECT count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max, round(avg(value), 3) AS v_mean, round(sum(value), 2) AS v_sum FROM vox", _VOX))
def voxel_statistics(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    s = voxels.statistics(_vox(nodes, spec))
    return s.select("n", "x_min", "x_max", "y_min", "y_max", "z_min", "z_max", F.round("v_mean", 3).alias("v_mean"), F.round("v_sum", 2).alias("v_sum"))


@query(_sql("SELECT x, y, round(value, 6) AS value FROM vox WHERE z = 2", _VOX))
def voxel_slice(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return voxels.slice_at(_vox(nodes, spec), "z", 2).select("x", "y", F.round("value", 6).alias("value"))


@query(_sql("SELECT x, y, z FROM vox WHERE abs((x + y + z - 20) / sqrt(3)) <= 1", _VOX))
def voxel_plane(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _place(voxels.plane(_vox(nodes, spec), (1.0, 1.0, 1.0), 20.0, 1.0))


@query(_sql("SELECT b.x, b.y, b.z, round(coalesce(value, -1), 6) AS value FROM (SELECT x, y, z FROM range(0, 6) i(x), range(2, 8) j(y), range(0, 4) k(z)) b LEFT JOIN vox USING (x, y, z)", _VOX))
def voxel_dense(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _value(voxels.dense(_vox(nodes, spec), (0, 2, 0), (5, 7, 3), -1.0))


@query(_sql("SELECT x, y, z, round(value, 6) AS value FROM vox WHERE NOT ((x - 8) * (x - 8) + (y - 8) * (y - 8) + (z - 2) * (z - 2) <= 16)", _VOX))
def voxel_remove_sphere(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    vox = _vox(nodes, spec)
    return _value(voxels.remove(vox, voxels.sphere(nodes.sparkSession, (8, 8, 2), 4.0, 0.0)))


@query(_sql("SELECT x, y, z, round(value, 6) AS value FROM vox WHERE NOT (x BETWEEN 2 AND 5 AND y BETWEEN 3 AND 6 AND z BETWEEN 0 AND 2) UNION ALL SELECT x, y, z, 7.5 FROM range(2, 6) i(x), range(3, 7) j(y), range(0, 3) k(z)", _VOX))
def voxel_put_box(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _value(voxels.put(_vox(nodes, spec), voxels.box(nodes.sparkSession, (2, 3, 0), (5, 6, 2), 7.5)))


@query(_sql("SELECT x, y, z, round(value, 6) AS value FROM vox WHERE x BETWEEN 4 AND 11 AND y BETWEEN 0 AND 9 AND z BETWEEN 1 AND 3", _VOX))
def voxel_box_filter(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _value(_vox(nodes, spec).filter(voxels.in_box((4, 0, 1), (11, 9, 3))))


_CC = "vc(x, y, z, comp) AS (SELECT x, y, z, (x * 100000 + y) * 10 + z FROM vox UNION SELECT w.x, w.y, w.z, v.comp FROM vc v, face, vox w WHERE w.x = v.x + a AND w.y = v.y + b AND w.z = v.z + d), lab AS MATERIALIZED (SELECT x, y, z, min(comp) AS comp FROM vc GROUP BY ALL), sized AS MATERIALIZED (SELECT comp, count(*) AS n FROM lab GROUP BY comp)"


@query(_sql("SELECT x, y, z FROM lab WHERE comp = (SELECT comp FROM sized ORDER BY n DESC, comp LIMIT 1)", _VOX, _FACE, _CC))
def voxel_largest_component(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _place(voxels.largest_component(cut(voxels.label(_vox(nodes, spec)))))


@query(_sql("SELECT x, y, z FROM lab JOIN sized USING (comp) WHERE n >= 3", _VOX, _FACE, _CC))
def voxel_sized_components(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _place(voxels.sized_components(cut(voxels.label(_vox(nodes, spec))), 3))


@query(_sql("SELECT count(*) AS n, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z FROM lab GROUP BY comp", _VOX, _FACE, _CC))
def voxel_centroids(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return voxels.centroids(voxels.label(_vox(nodes, spec))).select("n", *[F.round(k, 4).alias(k) for k in ("x", "y", "z")])


_DILATED = "grown AS MATERIALIZED (SELECT x, y, z FROM vox UNION SELECT x + a, y + b, z + d FROM vox, face)"


@query(_sql("SELECT x, y, z FROM grown", _VOX, _FACE, _DILATED))
def voxel_dilation(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _place(voxels.dilate(_vox(nodes, spec), 0.0))


@query(_sql("SELECT g.x, g.y, g.z FROM grown g, face, grown h WHERE h.x = g.x + a AND h.y = g.y + b AND h.z = g.z + d GROUP BY ALL HAVING count(*) = 6", _VOX, _FACE, _DILATED))
def voxel_closing(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _place(voxels.closing(_vox(nodes, spec), 0.0))


_STEPS = "seed AS MATERIALIZED (SELECT x, y, z FROM vox ORDER BY x, y, z LIMIT 3), st(x, y, z, step) USING KEY (x, y, z) AS (SELECT x, y, z, 0 FROM seed UNION SELECT w.x, w.y, w.z, min(s.step + 1) FROM st s, face, vox w LEFT JOIN recurring.st o ON o.x = w.x AND o.y = w.y AND o.z = w.z WHERE w.x = s.x + a AND w.y = s.y + b AND w.z = s.z + d AND w.value <= 60000 AND o.step IS NULL GROUP BY w.x, w.y, w.z)"


@query(_sql("SELECT x, y, z, step::BIGINT AS step FROM st", _VOX.replace("FROM nodes)", "FROM nodes WHERE z <= 9000000000)"), _FACE, _STEPS))
def voxel_distance_steps(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    vox = cut(_vox(nodes.filter("z <= 9000000000"), spec))
    return _place(voxels.distance_steps(vox, vox.orderBy("x", "y", "z").limit(3)).withColumn("step", F.col("step").cast("long")), "step")


@query(_sql("SELECT v.x, v.y, v.z, CASE WHEN s.step IS NULL THEN round(value, 6) ELSE -5 END AS value FROM vox v LEFT JOIN st s USING (x, y, z)", _VOX.replace("FROM nodes)", "FROM nodes WHERE z <= 9000000000)"), _FACE, _STEPS))
def voxel_fill_value(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    vox = cut(_vox(nodes.filter("z <= 9000000000"), spec))
    return _value(voxels.fill_value(vox, vox.orderBy("x", "y", "z").limit(3), -5.0))


@query(_sql("SELECT v.x, v.y, v.z, round(sqrt(min((v.x - s.x) ** 2 + (v.y - s.y) ** 2 + (v.z - s.z) ** 2)), 6) AS distance FROM vox v LEFT JOIN (SELECT * FROM vox WHERE z = 6) s ON (v.x - s.x) ** 2 + (v.y - s.y) ** 2 + (v.z - s.z) ** 2 <= 9 GROUP BY ALL", _VOX))
def voxel_distance_to(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    vox = _vox(nodes, spec)
    out = voxels.distance_to(vox, vox.filter("z = 6"), 3)
    return _place(out.withColumn("distance", F.round("distance", 6)), "distance")


# distances without a bound, and depth-first order


_SEEDS = "seeds AS MATERIALIZED (SELECT DISTINCT x, y, z FROM vox WHERE value % 97 < 1), gaps AS MATERIALIZED (SELECT v.x, v.y, v.z, abs(v.x - s.x) AS a, abs(v.y - s.y) AS b, abs(v.z - s.z) AS d, greatest(a, b, d) AS most, least(a, b, d) AS few FROM vox v, seeds s)"


def _seeds(vox: DataFrame) -> DataFrame:
    return vox.filter(F.col("value") % 97 < 1)


@query(_sql("SELECT x, y, z, min(a * a + b * b + d * d)::BIGINT AS d2, round(sqrt(min(a * a + b * b + d * d)), 6) AS distance FROM gaps GROUP BY x, y, z", _VOX, _SEEDS))
def voxel_distance_euclidean(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    vox = _vox(nodes, spec)
    return _place(distances.euclidean(vox, _seeds(vox)).withColumn("distance", F.round("distance", 6)), "d2", "distance")


@query(_sql("SELECT x, y, z, min(2 * most + a + b + d)::BIGINT AS distance FROM gaps GROUP BY x, y, z", _VOX, _SEEDS))
def voxel_distance_chamfer(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    vox = _vox(nodes, spec)
    return _place(distances.lattice(vox, _seeds(vox), 3, 4, 5).withColumn("distance", F.col("distance").cast("long")), "distance")


@query(_sql("SELECT x, y, z, round(min(sqrt(3) * few + sqrt(2) * (a + b + d - most - 2 * few) + 2 * most - (a + b + d) + few), 6) AS distance FROM gaps GROUP BY x, y, z", _VOX, _SEEDS))
def voxel_distance_straight_steps(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    vox = _vox(nodes, spec)
    return _place(distances.lattice(vox, _seeds(vox), 1, 2**0.5, 3**0.5).withColumn("distance", F.round("distance", 6)), "distance")


@query(_sql("SELECT x, y, z, min(a + b + d)::BIGINT AS distance FROM gaps GROUP BY x, y, z", _VOX, _SEEDS))
def voxel_distance_manhattan(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    vox = _vox(nodes, spec)
    return _place(distances.lattice(vox, _seeds(vox), 1).withColumn("distance", F.col("distance").cast("long")), "distance")


_PLACES = "sizes AS MATERIALIZED (SELECT node, count(*) AS size FROM paths GROUP BY node), shifts AS MATERIALIZED (SELECT node, (rec <> node)::INT + coalesce(sum(size) OVER (PARTITION BY CASE WHEN rec = node THEN -1 ELSE rec END ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM sfd JOIN sizes USING (node)), places AS MATERIALIZED (SELECT src AS node, sum(shift)::BIGINT AS \"at\", max(hops)::BIGINT AS depth FROM paths JOIN shifts USING (node) GROUP BY src)"


@query(_sql("SELECT node, root, \"at\", size, depth, \"at\" + size - 1 - depth AS post FROM places JOIN sizes USING (node) JOIN roots USING (node)", EDGES, SFD, PATHS, ROOTS, _PLACES))
def depth_first_order(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return ranges.depth_first(cut(flow.steepest(nodes, spec)))


@query(_sql("SELECT DISTINCT src AS node FROM paths WHERE node % 37 = 0 AND src <> node", EDGES, SFD, PATHS))
def upstream_of_many(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    order = ranges.depth_first(cut(flow.steepest(nodes, spec)))
    return ranges.upstream_in(order, nodes.filter("node % 37 = 0"))


@query(_sql("SELECT node, r, c, z::DOUBLE AS z FROM nodes, dims WHERE r BETWEEN 3 AND ny - 5 AND c BETWEEN 7 AND nx - 2"))
def raster_window(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    path = mounted_path(nodes.sparkSession)
    raster.write_raster(nodes, spec, path, tile=64)
    return raster.read_raster(nodes.sparkSession, path, (3, 7, spec.ny - 5, spec.nx - 2), "node long, r long, c long, z double")[0].filter("z is not null")


# communities


@query(_sql("SELECT round(2 * sum(w) FILTER (ra = rb) / sum(2 * w) - (SELECT sum(k * k) FROM (SELECT root, sum(w) AS k FROM (SELECT ra AS root, w FROM links UNION ALL SELECT rb, w FROM links) GROUP BY root)) / sum(2 * w) ** 2, 9) AS modularity FROM links", EDGES, SFD, PATHS, ROOTS, "links AS MATERIALIZED (SELECT e.node, e.nb, 2::DOUBLE AS w, a.root AS ra, b.root AS rb FROM edges e JOIN roots a ON a.node = e.node JOIN roots b ON b.node = e.nb WHERE e.node < e.nb)"))
def modularity_of_basins(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    root = to_root(cut(flow.steepest(nodes, spec))).select("node", F.col("root").alias("community"))
    links_ = modularity.undirected(neighbours(nodes, spec))
    return modularity.modularity(links_, root).select(F.round("modularity", 9).alias("modularity"))


@query()
def modularity_communities(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return modularity.communities(neighbours(nodes, spec), nodes, spec=spec)[0]


# shortest ways between two nodes, and objects


_ROUTE = (
    "high AS MATERIALIZED (SELECT node, nb, floor(dx * 10)::BIGINT + floor(abs(z - z_nb) / 1e9)::BIGINT AS w FROM edges WHERE z > 2000000000 AND z_nb > 2000000000)",
    "way(node, v) USING KEY (node) AS (SELECT min(node), 0::BIGINT FROM nodes WHERE z > 2000000000 UNION SELECT h.nb, min(w.v + h.w) FROM way w JOIN high h ON h.node = w.node LEFT JOIN recurring.way o ON o.node = h.nb WHERE o.v IS NULL OR w.v + h.w < o.v GROUP BY h.nb)",
    "best AS MATERIALIZED (SELECT * FROM (SELECT h.nb AS node, h.node AS \"to\", row_number() OVER (PARTITION BY h.nb ORDER BY a.v, h.node) AS k FROM high h JOIN way a ON a.node = h.node JOIN way b ON b.node = h.nb WHERE a.v + h.w = b.v) WHERE k = 1)",
    "back(node, step) AS (SELECT max(node), 0::BIGINT FROM way UNION ALL SELECT \"to\", step + 1 FROM back JOIN best USING (node))",
)


@query(_sql("SELECT (SELECT max(step) FROM back) - step AS step, node, v::DOUBLE AS value FROM back JOIN way USING (node)", EDGES, *_ROUTE))
def shortest_route_by_landmarks(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    w = F.floor(F.col("dx") * 10) + F.floor(F.abs(F.col("z") - F.col("z_nb")) / 1e9)
    high = nodes.filter("z > 2000000000")
    e = cut(neighbours(high, spec).select("node", "nb", w.alias("w")))
    start = high.agg(F.min("node")).first()[0]
    marks = [start, *[m for m in routes.extreme_nodes(e, spec) if m != start]]
    table = routes.landmark_distances(e, spec, marks, "w")
    goal = table.filter(F.col("d")[0].isNotNull()).agg(F.max("node")).first()[0]
    return routes.shortest_route(e, spec, table, start, goal, "w")[0]


_AIR = "air AS MATERIALIZED (SELECT x, y, k AS z FROM vox, range(0, 5) t(k) WHERE k >= z), ends AS MATERIALIZED (SELECT min({x: x, y: y, z: z}) AS p, max({x: x, y: y, z: z}) AS q FROM air WHERE z = 4)"


def _air(nodes: DataFrame, spec: GridSpec) -> tuple[DataFrame, tuple, tuple]:
    """The places above the surface in five layers, and the first and last of the highest."""
    vox = _vox(nodes, spec).filter("z <= 4").withColumn("z", F.explode(F.sequence(F.col("z"), F.lit(4).cast("long"))))
    vox = cut(vox)
    p, q = vox.filter("z = 4").agg(F.min(F.struct("x", "y", "z")), F.max(F.struct("x", "y", "z"))).first()
    return vox, tuple(p), tuple(q)


def _voxel_way(k: int, among: str) -> str:
    """CTEs of the k-th way between the ends through the places of a table: distances, the nearest place before each, the way."""
    near = "w.x = v.x + a AND w.y = v.y + b AND w.z = v.z + d"
    return (
        f"far{k}(x, y, z, v) USING KEY (x, y, z) AS (SELECT p.x, p.y, p.z, 0::BIGINT FROM ends UNION SELECT w.x, w.y, w.z, min(v.v + 1) FROM far{k} v, face, {among} w LEFT JOIN recurring.far{k} o ON o.x = w.x AND o.y = w.y AND o.z = w.z WHERE {near} AND o.v IS NULL GROUP BY w.x, w.y, w.z), "
        f"near{k} AS MATERIALIZED (SELECT w.x, w.y, w.z, min({{x: v.x, y: v.y, z: v.z}}) AS f FROM far{k} v, face, far{k} w WHERE {near} AND w.v = v.v + 1 GROUP BY w.x, w.y, w.z), "
        f"way{k}(x, y, z, v) AS (SELECT x, y, z, v FROM far{k}, ends WHERE x = q.x AND y = q.y AND z = q.z UNION ALL SELECT f.x, f.y, f.z, v - 1 FROM way{k} JOIN near{k} USING (x, y, z))"
    )


@query(_sql("SELECT v AS step, x, y, z, v::DOUBLE AS value FROM way1", _VOX, _FACE, _AIR, _voxel_way(1, "air")))
def voxel_shortest_route(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return routes.voxel_route(*_air(nodes, spec))


_APART = "open2 AS MATERIALIZED (SELECT * FROM air ANTI JOIN (SELECT x, y, z FROM way1, ends WHERE {x: x, y: y, z: z} NOT IN (p, q)) USING (x, y, z))"


@query(_sql("SELECT 1::BIGINT AS route, v AS step, x, y, z, v::DOUBLE AS value FROM way1 UNION ALL SELECT 2, v, x, y, z, v FROM way2", _VOX, _FACE, _AIR, _voxel_way(1, "air"), _APART, _voxel_way(2, "open2")))
def voxel_separate_routes(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return routes.separate_routes(*_air(nodes, spec), most=2, separation=0)


_OBJECT = """marked AS MATERIALIZED (SELECT x, y, z, comp FROM lab), bits AS MATERIALIZED (
  SELECT m.comp, m.x, m.y, m.z, count(*) FILTER (a + b + d = 1 AND s = 2) AS pairs, count(*) FILTER (a + b + d = 2 AND s = 4) AS squares, count(*) FILTER (a + b + d = 3 AND s = 8) AS cubes
  FROM (SELECT m.comp, m.x, m.y, m.z, a, b, d, (SELECT count(*) FROM marked w WHERE w.x BETWEEN m.x AND m.x + a AND w.y BETWEEN m.y AND m.y + b AND w.z BETWEEN m.z AND m.z + d) AS s
        FROM marked m, range(0, 2) i(a), range(0, 2) j(b), range(0, 2) k(d)) m GROUP BY ALL
), measured AS MATERIALIZED (SELECT comp, count(*) AS volume, sum(6 - 2 * pairs)::BIGINT AS area, sum(1 - pairs + squares - cubes)::BIGINT AS euler, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max,
  var_pop(x) AS xx, var_pop(y) AS yy, var_pop(z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM bits GROUP BY comp)"""


@query(_sql("SELECT volume, area, euler, x_min, x_max, y_min, y_max, z_min, z_max, round((xx + yy + zz) * volume * volume)::BIGINT AS spread, round(area::DOUBLE ** 1.5 / volume, 3) AS compactness, round(pi() ** (1 / 3.0) * (6.0 * volume) ** (2 / 3.0) / area, 3) AS sphericity FROM measured", _VOX, _FACE, _CC, _OBJECT))
def voxel_objects(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    out = shapes.segmented(_vox(nodes, spec))[1]
    spread = F.pow("length1", F.lit(2)) + F.pow("length2", F.lit(2)) + F.pow("length3", F.lit(2))
    spread = F.round(spread * F.col("volume") * F.col("volume")).cast("long").alias("spread")  # a whole number
    measures = [spread, *[F.round(n, 3).alias(n) for n in ("compactness", "sphericity")]]
    return out.select("volume", "area", "euler", *[f"{k}_{n}" for k in "xyz" for n in ("min", "max")], *measures)


_HULL = """spots AS MATERIALIZED (SELECT * FROM (SELECT x, y, z, x IN (min(x) OVER h, max(x) OVER h) AND y IN (min(y) OVER v, max(y) OVER v) AS e FROM vox WINDOW h AS (PARTITION BY y, z), v AS (PARTITION BY x, z)) WHERE e),
rims AS MATERIALIZED (
  SELECT p.z, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM spots p JOIN spots q ON q.z = p.z AND (q.x <> p.x OR q.y <> p.y) JOIN spots r ON r.z = p.z GROUP BY ALL
  HAVING bool_and(CASE sign((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)) WHEN 1 THEN true WHEN 0 THEN (r.x - p.x) * (q.x - p.x) + (r.y - p.y) * (q.y - p.y) BETWEEN 0 AND (q.x - p.x) ** 2 + (q.y - p.y) ** 2 ELSE false END)
), cand AS MATERIALIZED (
  SELECT row_number() OVER () AS i, * FROM (SELECT px AS x, py AS y, z FROM rims UNION SELECT qx, qy, z FROM rims UNION SELECT min(x), min(y), z FROM spots GROUP BY z HAVING count(*) = 1)
), triples AS MATERIALIZED (
  SELECT a.i AS a, b.i AS b, c.i AS c, (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) AS nx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) AS ny, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS nz, nx * a.x + ny * a.y + nz * a.z AS level
  FROM cand a JOIN cand b ON b.i > a.i JOIN cand c ON c.i > b.i
), sides AS MATERIALIZED (
  SELECT a, b, c, nx, ny, nz FROM triples, cand r WHERE nx <> 0 OR ny <> 0 OR nz <> 0 GROUP BY ALL
  HAVING min(sign(nx * r.x + ny * r.y + nz * r.z - level)) >= 0 OR max(sign(nx * r.x + ny * r.y + nz * r.z - level)) <= 0
), meet AS MATERIALIZED (
  SELECT DISTINCT unnest([a, b, c]) AS i, nx // g * u AS nx, ny // g * u AS ny, nz // g * u AS nz
  FROM (SELECT *, gcd(gcd(abs(nx), abs(ny)), abs(nz)) AS g, CASE WHEN nx < 0 OR (nx = 0 AND (ny < 0 OR (ny = 0 AND nz < 0))) THEN -1 ELSE 1 END AS u FROM sides)
)"""


@query(_sql("SELECT x, y, z FROM cand WHERE i IN (SELECT i FROM meet a JOIN meet b USING (i) JOIN meet c USING (i) WHERE a.nx * (b.ny * c.nz - b.nz * c.ny) - a.ny * (b.nx * c.nz - b.nz * c.nx) + a.nz * (b.nx * c.ny - b.ny * c.nx) <> 0)", _VOX, _HULL))
def voxel_convex_hull(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return hull.convex_hull(_vox(nodes, spec))
