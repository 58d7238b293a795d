"""Registered queries of the terrain engine, over the surface derived from ``events``, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boundary as B
from ..functions.grid import D4, D8, DIRECTIONS, GridSpec
from ..operators import accumulate as A
from ..operators import builder, depressions, flats, flow, graphs, hierarchy, ranges, rivers, terrain, traversal, voxels
from ..operators.iterate import to_root
from ..operators.neighbours import d4_neighbours, extreme_neighbour, links, neighbourhood_stats, neighbours, one_neighbour
from ..operators.tiles import grid_levels
from ..scratch import cut
from ..sources.grids import events_surface

Query = Callable[[SparkSession, str], DataFrame]

# Shared parts of the SQL: the grid, its nodes and edges, single flow, and paths to roots.
GRID = """grid AS MATERIALIZED (
  SELECT CASE count(*) WHEN 1000 THEN 40 WHEN 10000 THEN 100 WHEN 100000 THEN 400
         ELSE greatest(1, floor(sqrt(count(*)))) END::BIGINT AS nx, count(*) AS n FROM events
), dims AS MATERIALIZED (SELECT nx, ceil(n / nx)::BIGINT AS ny FROM grid),
nodes AS MATERIALIZED (
  SELECT event_id AS node, floor(event_id / nx)::BIGINT AS r, (event_id % nx)::BIGINT AS c,
         floor(value * 100 + 0.5)::BIGINT * 1000000 + event_id + {tilt} * floor(event_id / nx)::BIGINT AS z
  FROM events, dims
)"""
EDGES = """offs(dir, dr, dc) AS (VALUES (0,-1,-1),(1,-1,0),(2,-1,1),(3,0,-1),(4,0,1),(5,1,-1),(6,1,0),(7,1,1)),
near AS MATERIALIZED (
  SELECT node, z, r, c, dir, dr, dc, (r + dr) * nx + c + dc AS nb, sqrt(dr * dr + dc * dc) AS dx
  FROM nodes, offs, dims WHERE r + dr BETWEEN 0 AND ny - 1 AND c + dc BETWEEN 0 AND nx - 1
), edges AS MATERIALIZED (SELECT a.*, b.z AS z_nb FROM near a JOIN nodes b ON b.node = a.nb)"""
SFD = """sfd AS MATERIALIZED (
  SELECT n.node, coalesce(s.nb, n.node) AS rec, coalesce(s.dx, 0) AS dx, coalesce(s.slope, 0) AS slope
  FROM nodes n LEFT JOIN (
    SELECT node, nb, dx, (z - z_nb) / dx AS slope, row_number() OVER (PARTITION BY node ORDER BY (z - z_nb) / dx DESC, nb) AS k
    FROM edges WHERE z_nb < z) s ON s.node = n.node AND s.k = 1
)"""
PATHS = """paths(src, node, length, hops) AS (
  SELECT node, node, 0::DOUBLE, 0 FROM nodes
  UNION ALL SELECT p.src, s.rec, p.length + s.dx, p.hops + 1 FROM paths p JOIN sfd s ON s.node = p.node WHERE s.rec <> s.node
)"""
ROOTS = "roots AS MATERIALIZED (SELECT p.src AS node, p.node AS root, p.length, p.hops FROM paths p JOIN sfd s ON s.node = p.node WHERE s.rec = s.node)"


def _sql(body: str, *parts: str, tilted: bool = False) -> str:
    parts = (GRID.replace("{tilt}", "20000000000" if tilted else "0"), *parts)
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            nodes, spec = events_surface(spark, sf_dir, tilted=getattr(f, "tilted", False) or "tilted" in f.__name__)
            return f(nodes, spec)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_COLS = "SELECT node, nb, dir, round(dx, 6) AS dx FROM edges"


@query(_sql(_COLS, EDGES))
def d8_neighbours(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return neighbours(nodes, spec).select("node", "nb", F.col("dir").cast("long").alias("dir"), F.round("dx", 6).alias("dx"))


@query(_sql(_COLS + " WHERE dr = 0 OR dc = 0", EDGES))
def d4_neighbours_table(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return d4_neighbours(nodes, spec).select("node", "nb", F.col("dir").cast("long").alias("dir"), F.round("dx", 6).alias("dx"))


@query(_sql("SELECT a.node, count(*) AS n, sum(b.z)::BIGINT AS sum_z FROM nodes a, offs, dims, nodes b WHERE a.r + dr BETWEEN 0 AND ny - 1 AND b.node = (a.r + dr) * nx + ((a.c + dc + nx) % nx) GROUP BY a.node", "offs(dir, dr, dc) AS (VALUES (0,-1,-1),(1,-1,0),(2,-1,1),(3,0,-1),(4,0,1),(5,1,-1),(6,1,0),(7,1,1))"))
def periodic_neighbours(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    wrapped = GridSpec(spec.nx, spec.ny, periodic_ew=True)
    return neighbours(nodes, wrapped).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("z_nb").alias("sum_z"))


@query(_sql("SELECT node, CASE WHEN c < nx - 1 AND r < ny - 1 THEN node + nx + 1 END AS nb FROM nodes, dims"))
def bottom_right_neighbour(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return one_neighbour(nodes, spec, DIRECTIONS[7])


@query(_sql("SELECT node, CASE WHEN r IN (0, ny - 1) OR c IN (0, nx - 1) THEN 4 ELSE 1 END::TINYINT AS bc, (r IN (0, ny - 1) OR c IN (0, nx - 1)) AS can_out, NOT (r IN (0, ny - 1) OR c IN (0, nx - 1)) AS can_give FROM nodes, dims"))
def boundary_codes(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    out = builder.codes(nodes, spec)
    return out.select("node", "bc", B.can_out(F.col("bc")).alias("can_out"), B.can_give(F.col("bc")).alias("can_give"))


@query(_sql("SELECT node * 4 + CASE dir WHEN 4 THEN 0 WHEN 7 THEN 1 WHEN 6 THEN 2 ELSE 3 END AS link, node AS a, nb AS b, CASE WHEN z > z_nb THEN 1 ELSE 0 END::TINYINT AS state FROM edges WHERE dir IN (4, 5, 6, 7)", EDGES))
def link_table(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return links(nodes, spec).select("link", "a", "b", "state")


@query(_sql("SELECT node, nb, z_nb AS z FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY z_nb, nb) AS k FROM edges) WHERE k = 1", EDGES))
def lowest_neighbour(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return extreme_neighbour(nodes, spec)


@query(_sql("SELECT node, count(*) AS n, round(avg(z_nb) / 1e6, 3) AS mean, min(z_nb) AS least, max(z_nb) AS most FROM edges GROUP BY node", EDGES))
def neighbourhood_statistics(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    s = neighbourhood_stats(nodes, spec)
    return s.select("node", "n", F.round(F.col("mean") / 1e6, 3).alias("mean"), "least", "most")


def _sfd_out(s: DataFrame) -> DataFrame:
    return s.select("node", "rec", F.round("dx", 6).alias("dx"), F.round(F.col("slope") / 1e6, 6).alias("slope"))


_SFD_OUT = "SELECT node, rec, round(dx, 6) AS dx, round(slope / 1e6, 6) AS slope FROM sfd"


@query(_sql(_SFD_OUT, EDGES, SFD))
def steepest_receiver(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _sfd_out(flow.steepest(nodes, spec))


@query(_sql(_SFD_OUT, EDGES, SFD, tilted=True))
def steepest_receiver_tilted(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _sfd_out(flow.steepest(nodes, spec))


@query(_sql("SELECT n.node, coalesce(e.nb, n.node) AS rec FROM nodes n LEFT JOIN (SELECT node, nb, row_number() OVER (PARTITION BY node ORDER BY z_nb) AS k FROM edges WHERE z_nb < z AND (dr = 0 OR dc = 0)) e ON e.node = n.node AND k = 1", EDGES))
def lowest_receiver_d4(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return flow.lowest(nodes, spec, D4).select("node", "rec")


@query(_sql("SELECT s.node, CASE WHEN s.rec = s.node THEN 0 ELSE round((a.z - b.z) / s.dx / 1e6, 6) END AS gradient FROM sfd s JOIN nodes a ON a.node = s.node JOIN nodes b ON b.node = s.rec", EDGES, SFD))
def sfd_gradient(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    g = flow.sfd_gradient(nodes, cut(flow.steepest(nodes, spec)))
    return g.select("node", F.round(F.col("gradient") / 1e6, 6).alias("gradient"))


@query(_sql("SELECT n.node, count(s.node) AS n FROM nodes n LEFT JOIN sfd s ON s.rec = n.node AND s.node <> n.node GROUP BY n.node", EDGES, SFD))
def donor_counts(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return flow.sfd_donors(cut(flow.steepest(nodes, spec))).select("node", "n")


_DOWN = "down AS MATERIALIZED (SELECT *, (z - z_nb) / dx AS slope FROM edges WHERE z_nb < z)"


def _weights(expression: str) -> str:
    return _sql(f"SELECT node, nb, round(w / sum(w) OVER (PARTITION BY node), 6) AS weight FROM (SELECT *, {expression} AS w FROM down)", EDGES, _DOWN)


def _weights_out(e: DataFrame) -> DataFrame:
    return e.select("node", "nb", F.round("weight", 6).alias("weight"))


@query(_weights("slope"))
def mfd_edges_freeman(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _weights_out(flow.partition(flow.downhill(nodes, spec), "freeman"))


@query(_weights("pow(slope / 1e6, 1.5)"))
def mfd_edges_quinn(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    e = flow.downhill(nodes, spec).withColumn("slope", F.col("slope") / 1e6)
    return _weights_out(flow.partition(e, "quinn", 1.5))


@query(_weights("pow(slope / 1e6, 1 + count(*) OVER (PARTITION BY node) / 2)"))
def mfd_edges_seibert(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    e = flow.downhill(nodes, spec).withColumn("slope", F.col("slope") / 1e6)
    return _weights_out(flow.partition(e, "seibert"))


@query(_sql("SELECT node, nb, CASE WHEN k = 1 THEN 1 WHEN rn = 1 THEN 0.8 ELSE round(0.2 / (k - 1), 6) END::DOUBLE AS weight FROM (SELECT *, count(*) OVER (PARTITION BY node) AS k, row_number() OVER (PARTITION BY node ORDER BY slope DESC, nb) AS rn FROM down)", EDGES, _DOWN))
def mfd_edges_tarboton(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _weights_out(flow.partition(flow.downhill(nodes, spec), "tarboton"))


@query(_weights("1"))
def link_weights_equal(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _weights_out(flow.exponent_weights(flow.downhill(nodes, spec), 0))


@query(_sql("SELECT node, round(avg(slope) / 1e6, 4) AS gradient FROM down GROUP BY node", EDGES, _DOWN))
def mean_gradient(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return flow.mean_gradient(flow.downhill(nodes, spec)).select("node", F.round(F.col("gradient") / 1e6, 4).alias("gradient"))


@query(_sql("SELECT n.node, count(d.nb) AS n FROM nodes n LEFT JOIN down d ON d.node = n.node GROUP BY n.node", EDGES, _DOWN))
def receiver_counts(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return flow.receiver_counts(nodes, flow.downhill(nodes, spec))


@query(_sql("SELECT node FROM sfd JOIN nodes USING (node), dims WHERE rec = node AND NOT (r IN (0, ny - 1) OR c IN (0, nx - 1))", EDGES, SFD))
def pits(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return flow.pits(flow.steepest(nodes, spec), builder.codes(nodes, spec))


@query(_sql("SELECT node FROM nodes WHERE node NOT IN (SELECT nb FROM down)", EDGES, _DOWN))
def sources(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return graphs.sources(nodes, flow.downhill(nodes, spec))


_AREA = "area AS MATERIALIZED (SELECT node, count(*) AS value FROM paths GROUP BY node)"


def _area(nodes: DataFrame, spec: GridSpec) -> tuple[DataFrame, DataFrame]:
    sfd = cut(flow.steepest(nodes, spec))
    return sfd, A.accumulate_sfd(sfd, sfd.select("node", F.lit(1).cast("long").alias("value")))


@query(_sql("SELECT node, value FROM area", EDGES, SFD, PATHS, _AREA))
def drainage_area_sfd(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _area(nodes, spec)[1]


@query(_sql("SELECT node, value FROM area", EDGES, SFD, PATHS, _AREA, tilted=True))
def drainage_area_tilted(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _area(nodes, spec)[1]


@query(_sql("SELECT p.node, sum(n.node % 7)::BIGINT AS value FROM paths p JOIN nodes n ON n.node = p.src GROUP BY p.node", EDGES, SFD, PATHS))
def accumulate_variable_sfd(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return A.accumulate_sfd(cut(flow.steepest(nodes, spec)), nodes.select("node", (F.col("node") % 7).alias("value")))


@query(_sql("SELECT sum(value)::BIGINT AS value FROM area JOIN sfd USING (node) WHERE rec = node", EDGES, SFD, PATHS, _AREA))
def sum_at_outlets(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return A.sum_at_outlets(*_area(nodes, spec))


@query(_sql("SELECT node, root, hops::BIGINT AS hops, round(length, 6) AS length FROM roots", EDGES, SFD, PATHS, ROOTS, tilted=True))
def distance_from_outlets_tilted(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return to_root(flow.steepest(nodes, spec)).select("node", "root", "hops", F.round("length", 6).alias("length"))


def _from_sources(f: str) -> str:
    return _sql(f"SELECT node, round({f}(length), 6) AS value FROM paths WHERE src NOT IN (SELECT rec FROM sfd WHERE rec <> node) GROUP BY node", EDGES, SFD, PATHS)


@query(_from_sources("max"))
def max_distance_from_sources_sfd(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return A.distance_from_sources(cut(flow.steepest(nodes, spec)), True).select("node", F.round("value", 6).alias("value"))


@query(_from_sources("min"))
def min_distance_from_sources_sfd(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return A.distance_from_sources(cut(flow.steepest(nodes, spec)), False).select("node", F.round("value", 6).alias("value"))


@query(_sql("SELECT node, root, dense_rank() OVER (ORDER BY root) - 1 AS basin FROM roots", EDGES, SFD, PATHS, ROOTS))
def basin_labels(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return A.basins(cut(flow.steepest(nodes, spec)))


@query(_sql("SELECT root, count(*) AS n, min(r) AS r_min, max(r) AS r_max, min(c) AS c_min, max(c) AS c_max FROM roots JOIN nodes USING (node) GROUP BY root", EDGES, SFD, PATHS, ROOTS))
def basin_bbox(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return A.basin_boxes(to_root(flow.steepest(nodes, spec)).select("node", "root"), spec)


_TOP = "top AS MATERIALIZED (SELECT node FROM area ORDER BY value DESC, node LIMIT 1)"


def _top(area: DataFrame) -> DataFrame:
    return area.orderBy(F.col("value").desc(), "node").limit(1).select("node")


@query(_sql("SELECT p.src AS node FROM paths p, top WHERE p.node = top.node AND p.src <> top.node", EDGES, SFD, PATHS, _AREA, _TOP))
def upstream_nodes(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    sfd, area = _area(nodes, spec)
    return ranges.upstream_in(ranges.depth_first(sfd), _top(area))


_DEEP = "deep AS MATERIALIZED (SELECT src FROM paths ORDER BY hops DESC, src LIMIT 1)"


@query(_sql("SELECT p.hops::BIGINT AS step, p.node FROM paths p, deep WHERE p.src = deep.src", EDGES, SFD, PATHS, _DEEP))
def trace_flow_path(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    sfd = cut(flow.steepest(nodes, spec))
    far = to_root(sfd).orderBy(F.col("hops").desc(), "node").first()
    return A.flow_path(sfd, far["node"], far["hops"]).select(F.col("step").cast("long").alias("step"), "node")


@query(_sql("SELECT p.node FROM paths p, deep WHERE p.src = deep.src AND p.node <> deep.src", EDGES, SFD, PATHS, _DEEP))
def downstream_nodes(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    sfd = cut(flow.steepest(nodes, spec))
    far = to_root(sfd).orderBy(F.col("hops").desc(), "node").limit(1).select("node")
    return A.downstream(A.as_edges(sfd), far).select("node")


@query(_sql("SELECT a.node, s.rec AS receiver, r.root AS basin, a.value AS area, round(r.length, 6) AS flow_distance FROM area a JOIN sfd s USING (node) JOIN roots r USING (node) WHERE a.value > 8", EDGES, SFD, PATHS, ROOTS, _AREA))
def river_nodes(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    sfd, area = _area(nodes, spec)
    out = rivers.river_network(sfd, nodes, area, 8)
    return out.select("node", "receiver", "basin", "area", F.round("flow_distance", 6).alias("flow_distance"))


@query(_sql("SELECT node FROM area WHERE value > 8 AND node NOT IN (SELECT s.rec FROM sfd s JOIN area a ON a.node = s.node WHERE a.value > 8 AND s.rec <> s.node)", EDGES, SFD, PATHS, _AREA))
def river_heads(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return rivers.river_heads(*_area(nodes, spec), 8)


@query(_sql("SELECT e.node, a.root AS basin, e.z, e.nb AS other FROM edges e JOIN roots a ON a.node = e.node JOIN roots b ON b.node = e.nb WHERE a.root <> b.root", EDGES, SFD, PATHS, ROOTS))
def drainage_divides(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return rivers.divides(cut(flow.steepest(nodes, spec)), nodes, spec)


@query(_sql("SELECT node, value >= 5 AS mask FROM area", EDGES, SFD, PATHS, _AREA))
def mask_by_area(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return A.mask_by_area(_area(nodes, spec)[1], 5)


@query(_sql("SELECT node, CASE WHEN z < 3000000000 THEN 0 WHEN r IN (0, ny - 1) OR c IN (0, nx - 1) THEN 4 ELSE 1 END::TINYINT AS bc FROM nodes, dims"))
def recast_below_z(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return A.recast_below(builder.codes(nodes, spec), 3_000_000_000).select("node", "bc")


@query(_sql("SELECT node, max(abs(z - z_nb)) AS relief FROM edges GROUP BY node", EDGES))
def local_relief_1(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return A.local_relief(nodes, spec, 1.5)


_LEVELS = "lv(node, level) AS (SELECT node, 0 FROM nodes WHERE node NOT IN (SELECT node FROM down) UNION SELECT d.node, l.level + 1 FROM lv l JOIN down d ON d.nb = l.node), levels AS MATERIALIZED (SELECT node, max(level)::BIGINT AS level FROM lv GROUP BY node)"


@query(_sql("SELECT node, level FROM levels", EDGES, _DOWN, _LEVELS))
def topological_level(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return grid_levels(flow.downhill(nodes, spec), nodes, spec)


_MFD = "w AS MATERIALIZED (SELECT node, nb, dx, slope / sum(slope) OVER (PARTITION BY node) AS weight FROM down), sent(src, node, value) AS (SELECT node, node, 1::DOUBLE FROM nodes UNION ALL SELECT s.src, w.nb, s.value * w.weight FROM sent s JOIN w ON w.node = s.node)"


@query(_sql("SELECT node, round(sum(value), 6) AS value FROM sent GROUP BY node", EDGES, _DOWN, _MFD))
def drainage_area_mfd(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    e = cut(flow.partition(flow.downhill(nodes, spec), "freeman"))
    return A.accumulate_mfd(e, nodes, spec=spec).select("node", F.round("value", 6).alias("value"))


def _mfd_far(f: str) -> str:
    return _sql(f"SELECT node, round({f}(length), 6) AS value FROM walk GROUP BY node", EDGES, _DOWN, "walk(node, length) AS (SELECT node, 0::DOUBLE FROM nodes WHERE node NOT IN (SELECT nb FROM down) UNION SELECT d.nb, w.length + d.dx FROM walk w JOIN down d ON d.node = w.node)")


@query(_mfd_far("max"))
def max_distance_from_sources_mfd(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    e = cut(flow.downhill(nodes, spec))
    return A.mfd_distance(e, nodes, True, True, spec=spec).select("node", F.round("value", 6).alias("value"))


@query(_mfd_far("min"))
def min_distance_from_sources_mfd(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    e = cut(flow.downhill(nodes, spec))
    return A.mfd_distance(e, nodes, False, True, spec=spec).select("node", F.round("value", 6).alias("value"))


# Levels spread inwards from the rim; a node's value is replaced while it falls.
_FILL = "fill(node, v) USING KEY (node) AS (SELECT node, z FROM nodes, dims WHERE (r IN (0, ny - 1) OR c IN (0, nx - 1)) UNION SELECT e.nb, min(greatest(f.v, e.z_nb)) FROM fill f JOIN edges e ON e.node = f.node LEFT JOIN recurring.fill o ON o.node = e.nb WHERE o.v IS NULL OR greatest(f.v, e.z_nb) < o.v GROUP BY e.nb)"


@query(_sql("SELECT node, z, v AS filled FROM nodes JOIN fill USING (node)", EDGES, _FILL))
def filled_surface(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return depressions.fill(nodes, spec)


@query(_sql("SELECT node, v - z AS depth FROM nodes JOIN fill USING (node)", EDGES, _FILL))
def lake_depth(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return depressions.lake_depth(depressions.fill(nodes, spec))


@query(_sql("SELECT a.root AS b1, b.root AS b2, min(greatest(e.z, e.z_nb)) AS pass_z FROM edges e JOIN roots a ON a.node = e.node JOIN roots b ON b.node = e.nb WHERE a.root < b.root GROUP BY ALL", EDGES, SFD, PATHS, ROOTS))
def basin_passes(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return depressions.basin_passes(nodes, cut(flow.steepest(nodes, spec)), spec).select("b1", "b2", "pass_z")


@query(_sql("SELECT n.node FROM nodes n, dims WHERE r NOT IN (0, ny - 1) AND c NOT IN (0, nx - 1) AND node NOT IN (SELECT node FROM down)", EDGES, _DOWN))
def sink_nodes(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return depressions.sinks(nodes, spec)


# Receivers with a closed rim, basins by them, and the passes over which a flood from the rim enters each basin: the lowest
# pass from what is reached to what isn't, one after the other.
_CLOSED = """cs AS MATERIALIZED (SELECT s.node, CASE WHEN r IN (0, ny - 1) OR c IN (0, nx - 1) THEN s.node ELSE s.rec END AS rec FROM sfd s JOIN nodes n ON n.node = s.node, dims),
cw(src, node) AS (SELECT node, node FROM cs UNION ALL SELECT w.src, s.rec FROM cw w JOIN cs s ON s.node = w.node WHERE s.rec <> s.node),
cr AS MATERIALIZED (SELECT w.src AS node, w.node AS root FROM cw w JOIN cs s ON s.node = w.node WHERE s.rec = s.node),
lowest AS MATERIALIZED (
  SELECT a.root AS b1, b.root AS b2, min(struct_pack(z := greatest(e.z, e.z_nb), u := e.node, v := e.nb)) AS p
  FROM edges e JOIN cr a ON a.node = e.node JOIN cr b ON b.node = e.nb WHERE a.root < b.root GROUP BY ALL
)"""
_ENTERED = """ways AS MATERIALIZED (SELECT b1 AS b, b2 AS o, p.z AS z, p.u AS here, p.v AS there FROM lowest UNION ALL SELECT b2, b1, p.z, p.v, p.u FROM lowest),
reached(b, here, there, z) USING KEY (b) AS (
  SELECT node, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM nodes, dims WHERE r IN (0, ny - 1) OR c IN (0, nx - 1)
  UNION SELECT * FROM (
    SELECT w.b, w.here, w.there, w.z FROM recurring.reached r JOIN ways w ON w.o = r.b LEFT JOIN recurring.reached q ON q.b = w.b
    WHERE q.b IS NULL AND EXISTS (SELECT 1 FROM reached) ORDER BY w.z, least(w.here, w.there), greatest(w.here, w.there) LIMIT 1)
), exits AS MATERIALIZED (SELECT * FROM reached WHERE here IS NOT NULL)"""
_LENGTH = "round(CASE WHEN m.node IS NULL THEN CASE WHEN s.rec = s.node THEN 0 ELSE d.dx END ELSE sqrt((floor(m.node / nx) - floor(m.rec / nx)) ** 2 + (m.node % nx - m.rec % nx) ** 2) END, 6) AS dx"
_MOVED = f"SELECT s.node, coalesce(m.rec, s.rec) AS rec, {_LENGTH} FROM cs s LEFT JOIN moved m ON m.node = s.node LEFT JOIN sfd d ON d.node = s.node, dims"


def _rerouted(nodes: DataFrame, spec: GridSpec, method: str) -> DataFrame:
    coded = builder.codes(nodes, spec)
    return depressions.reroute(coded, cut(flow.steepest(coded, spec)), spec, method=method).select("node", "rec", F.round("dx", 6).alias("dx"))


@query(_sql(_MOVED, EDGES, SFD, _CLOSED, _ENTERED, "moved(node, rec) AS (SELECT here, there FROM exits UNION ALL SELECT s.rec, s.node FROM moved m JOIN cs s ON s.node = m.node WHERE s.rec <> s.node)"))
def rerouted_receivers(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _rerouted(nodes, spec, "carve")


@query(_sql(_MOVED, EDGES, SFD, _CLOSED, _ENTERED, "moved AS MATERIALIZED (SELECT b AS node, there AS rec FROM exits)"))
def rerouted_receivers_simple(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _rerouted(nodes, spec, "simple")


_LAKE = """wet AS MATERIALIZED (SELECT n.node, x.b, x.here, x.there FROM nodes n JOIN cr USING (node) JOIN exits x ON x.b = cr.root WHERE n.z < x.z OR n.node = x.here),
wave(node, h) USING KEY (node) AS (SELECT node, 0 FROM wet WHERE node = here
  UNION SELECT e.nb, min(w.h + 1) FROM wave w JOIN edges e ON e.node = w.node JOIN wet a ON a.node = e.node JOIN wet b ON b.node = e.nb AND b.b = a.b LEFT JOIN recurring.wave o ON o.node = e.nb WHERE o.h IS NULL GROUP BY e.nb),
moved AS MATERIALIZED (SELECT node, there AS rec FROM wet WHERE node = here UNION ALL SELECT node, nb FROM (
  SELECT e.node, e.nb, row_number() OVER (PARTITION BY e.node ORDER BY e.dx, e.nb) AS k FROM edges e JOIN wet a ON a.node = e.node JOIN wet b ON b.node = e.nb AND b.b = a.b JOIN wave u ON u.node = e.node JOIN wave v ON v.node = e.nb AND v.h = u.h - 1) WHERE k = 1)"""


@query(_sql(_MOVED, EDGES, SFD, _CLOSED, _ENTERED, _LAKE))
def rerouted_receivers_fill(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _rerouted(nodes, spec, "fill")


_FLATS = """flooded AS MATERIALIZED (SELECT node, r, c, v FROM nodes JOIN fill USING (node)),
sides AS MATERIALIZED (SELECT e.node, e.nb, a.v, b.v AS v_nb FROM edges e JOIN flooded a ON a.node = e.node JOIN flooded b ON b.node = e.nb),
still AS MATERIALIZED (SELECT s.node, bool_or(v_nb > v) AS under FROM sides s JOIN nodes n USING (node), dims WHERE r NOT IN (0, ny - 1) AND c NOT IN (0, nx - 1) GROUP BY s.node HAVING NOT bool_or(v_nb < v)),
level AS MATERIALIZED (SELECT s.node, s.nb, q.node IS NOT NULL AS inside FROM sides s JOIN still p ON p.node = s.node LEFT JOIN still q ON q.node = s.nb WHERE v = v_nb),
toward(node, d) USING KEY (node) AS (SELECT DISTINCT node, 1 FROM level WHERE NOT inside
  UNION SELECT l.nb, min(t.d + 1) FROM toward t JOIN level l ON l.node = t.node AND inside LEFT JOIN recurring.toward o ON o.node = l.nb WHERE o.d IS NULL GROUP BY l.nb),
away(node, d) USING KEY (node) AS (SELECT node, 1 FROM still WHERE under
  UNION SELECT l.nb, min(t.d + 1) FROM away t JOIN level l ON l.node = t.node AND inside LEFT JOIN recurring.away o ON o.node = l.nb WHERE o.d IS NULL GROUP BY l.nb),
flat(node, f) USING KEY (node) AS (SELECT node, node FROM still
  UNION SELECT l.nb, min(t.f) FROM flat t JOIN level l ON l.node = t.node AND inside JOIN recurring.flat o ON o.node = l.nb WHERE t.f < o.f GROUP BY l.nb)"""


@query(_sql("SELECT w.node, n.z, w.v + coalesce(s.steps, 0) AS filled, coalesce(s.steps, 0)::BIGINT AS steps FROM flooded w JOIN nodes n USING (node) LEFT JOIN (SELECT node, 2 * t.d + coalesce(max(a.d) OVER (PARTITION BY f) - a.d, 0) AS steps FROM flat LEFT JOIN toward t USING (node) LEFT JOIN away a USING (node)) s USING (node)", EDGES, _FILL, _FLATS))
def draining_fill(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return flats.fill_draining(nodes, spec, 1).select("node", "z", F.col("filled").cast("long").alias("filled"), "steps")


_TREE = """closed AS MATERIALIZED (SELECT node AS b, v AS spill FROM cs JOIN fill USING (node) JOIN nodes USING (node), dims WHERE rec = node AND r NOT IN (0, ny - 1) AND c NOT IN (0, nx - 1)),
inner_passes AS MATERIALIZED (SELECT b1, b2, p.z AS z, row_number() OVER (ORDER BY p.z, b1, b2) AS k FROM lowest JOIN closed x ON x.b = b1 JOIN closed y ON y.b = b2 WHERE p.z < least(x.spill, y.spill)),
side(k, s, b) AS (SELECT k, 1, b1 FROM inner_passes UNION SELECT k, 2, b2 FROM inner_passes
  UNION SELECT t.k, t.s, CASE WHEN i.b1 = t.b THEN i.b2 ELSE i.b1 END FROM side t JOIN inner_passes i ON i.k < t.k AND (i.b1 = t.b OR i.b2 = t.b)),
parts AS MATERIALIZED (SELECT k, s, min(b) AS label, count(*) AS n FROM side WHERE k NOT IN (SELECT x.k FROM side x JOIN side y ON x.k = y.k AND x.b = y.b AND x.s = 1 AND y.s = 2) GROUP BY k, s),
made AS MATERIALIZED (SELECT k, min(label) AS label, sum(n)::BIGINT AS n FROM parts GROUP BY k),
deps AS MATERIALIZED (SELECT b AS label, 1::BIGINT AS n, NULL::BIGINT AS formed, b, NULL::BIGINT AS k FROM closed UNION ALL SELECT label, n, z, label, k FROM made JOIN inner_passes USING (k)),
tree AS MATERIALIZED (SELECT d.*, coalesce(i.z, c.spill) AS spill, m.label AS parent_label, m.n AS parent_basins FROM deps d JOIN closed c ON c.b = d.label LEFT JOIN parts p ON p.label = d.label AND p.n = d.n LEFT JOIN made m ON m.k = p.k LEFT JOIN inner_passes i ON i.k = p.k),
within AS MATERIALIZED (SELECT label, n, label AS b FROM deps WHERE k IS NULL UNION SELECT d.label, d.n, s.b FROM deps d JOIN side s ON s.k = d.k)"""


@query(_sql("SELECT t.label, t.n AS n_basins, t.formed::DOUBLE AS formed, t.spill::DOUBLE AS spill, t.parent_label, t.parent_basins, coalesce(w.cells, 0) AS n_cells, coalesce(w.volume, 0)::DOUBLE AS volume FROM tree t LEFT JOIN (SELECT t.label, t.n, count(*) AS cells, sum(t.spill - c.z) AS volume FROM tree t JOIN within w ON w.label = t.label AND w.n = t.n JOIN cr ON cr.root = w.b JOIN nodes c ON c.node = cr.node WHERE c.z < t.spill GROUP BY t.label, t.n) w ON w.label = t.label AND w.n = t.n", EDGES, SFD, _FILL, _CLOSED, _TREE))
def depression_hierarchy(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    coded = builder.codes(nodes, spec)
    return hierarchy.hierarchy(coded, cut(flow.steepest(coded, spec)), spec)


@query(_sql("SELECT p.node, n.z, least(n.z::DOUBLE, min(m.z)) AS carved FROM paths p JOIN nodes m ON m.node = p.src JOIN nodes n ON n.node = p.node GROUP BY p.node, n.z", EDGES, SFD, PATHS))
def carved_surface(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return depressions.carve(nodes, cut(flow.steepest(nodes, spec)))


def _stencil(expression: str) -> str:
    return _sql(f"SELECT node, round({expression}, 4) AS value FROM (SELECT *, (z_nb - z) / 1e6 AS dz FROM edges) GROUP BY node", EDGES)


def _scaled(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("z", F.col("z") / 1e6)


@query(_stencil("degrees(atan(max(abs(dz) / dx)))"))
def slope_degrees(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return terrain.slope(_scaled(nodes), spec).select("node", F.round("slope", 4).alias("value"))


@query(_stencil("sqrt(avg(dz * dz))"))
def roughness(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return terrain.roughness(_scaled(nodes), spec).select("node", F.round("roughness", 4).alias("value"))


@query(_stencil("avg(dz / (dx * dx))"))
def curvature(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return terrain.curvature(_scaled(nodes), spec).select("node", F.round("curvature", 4).alias("value"))


@query(_stencil("greatest(0, -avg(dz))"))
def exposure(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return terrain.exposure(_scaled(nodes), spec).select("node", F.round("exposure", 4).alias("value"))


@query(_stencil("sum(CASE WHEN dz > 0 THEN dz / dx ELSE 0 END) / count(*)"))
def shelter(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return terrain.shelter(_scaled(nodes), spec).select("node", F.round("shelter", 4).alias("value"))


@query(_sql("SELECT node, round(CASE WHEN sx = 0 AND sy = 0 THEN -1 ELSE (degrees(atan2(sy, -sx)) + CASE WHEN degrees(atan2(sy, -sx)) < 0 THEN 360 ELSE 0 END) END, 4) AS value FROM (SELECT node, sum((z_nb - z) / 1e6 * dc * CASE WHEN dr <> 0 AND dc <> 0 THEN 0.707::DOUBLE ELSE 1 END) AS sx, sum((z_nb - z) / 1e6 * dr * CASE WHEN dr <> 0 AND dc <> 0 THEN 0.707::DOUBLE ELSE 1 END) AS sy FROM edges GROUP BY node)", EDGES))
def aspect(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return terrain.aspect(_scaled(nodes), spec).select("node", F.round("aspect", 4).alias("value"))


@query(_sql("""SELECT w.node, CASE WHEN k < 8 THEN 0 ELSE round(greatest(0, cos(radians(45::DOUBLE)) * cos(atan(sqrt(gx * gx + gy * gy))) + sin(radians(45::DOUBLE)) * sin(atan(sqrt(gx * gx + gy * gy))) * cos(radians(135::DOUBLE) - atan2(gy, -gx))), 6) END AS shade FROM (
  SELECT node, count(*) AS k,
    sum(CASE dir WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 7 THEN 1 WHEN 0 THEN -1 WHEN 3 THEN -2 WHEN 5 THEN -1 ELSE 0 END * (z_nb / 1e9)) / 8 AS gx,
    sum(CASE dir WHEN 5 THEN 1 WHEN 6 THEN 2 WHEN 7 THEN 1 WHEN 0 THEN -1 WHEN 1 THEN -2 WHEN 2 THEN -1 ELSE 0 END * (z_nb / 1e9)) / 8 AS gy
  FROM edges GROUP BY node) w""", EDGES))
def hillshade(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return terrain.hillshade(nodes.withColumn("z", F.col("z") / 1e9), spec).select("node", F.round("shade", 6).alias("shade"))


@query(_sql("SELECT node, coalesce(max(z + c * 1000000) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > z + c * 1000000, false) AS shadow FROM nodes"))
def cast_shadow(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return terrain.cast_shadow(nodes, spec, "right", 1_000_000)


@query(_sql("SELECT node, round(avg(z / 1e6) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS value FROM (SELECT node, r, c, avg(z) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS z FROM nodes)"))
def box_blur(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return terrain.blur(_scaled(nodes), spec, 1, gaussian=False).select("node", F.round("z", 2).alias("value"))


@query(_sql("SELECT node, CASE WHEN z <= 2000000000 THEN 0 WHEN z <= 5000000000 THEN 1 WHEN z <= 10000000000 THEN 2 ELSE 3 END::BIGINT AS band FROM nodes"))
def elevation_bands(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return nodes.select("node", terrain.bands(F.col("z"), [2e9, 5e9, 1e10]).alias("band"))


@query(_sql("SELECT node FROM nodes ORDER BY z, node LIMIT 10"))
def lowest_outlets_topk(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return builder.extreme_nodes(builder.filled(nodes), 10)


@query(_sql("SELECT node FROM nodes WHERE sqrt((r - 12) * (r - 12) + (c - 15) * (c - 15)) <= 5.5"))
def nodes_within_radius(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return A.nodes_within(nodes, spec, 12, 15, 5.5)


@query(_sql("SELECT n.node, CASE WHEN z <= 2000000000 THEN 0 WHEN node IN (SELECT node FROM edges WHERE z_nb <= 2000000000) THEN 3 ELSE 1 END::TINYINT AS node_type FROM nodes n", EDGES))
def sea_level_types(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return builder.sea_level(builder.filled(nodes), spec, 2e9).select("node", "node_type")


@query(_sql("SELECT t::TINYINT AS node_type, count(*) AS n FROM (SELECT CASE WHEN c IN (0, nx - 1) THEN 5 WHEN r IN (0, ny - 1) THEN 3 ELSE 1 END AS t FROM nodes, dims) GROUP BY t"))
def preset_type_counts(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    out = builder.borders(builder.preset(nodes, spec, "periodic_ew"), spec, B.PERIODIC, "EW")
    return builder.count_types(out).select("node_type", "n")


@query(_sql("SELECT count(*) AS n_edges, (SELECT count(*) FROM nodes) AS n_nodes, max(k) AS max_degree, round(avg(slope) / 1e6, 4) AS mean_slope FROM (SELECT slope, count(*) OVER (PARTITION BY node) AS k FROM down)", EDGES, _DOWN))
def graph_statistics(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    s = graphs.statistics(nodes, cut(flow.downhill(nodes, spec)))
    return s.select("n_edges", "n_nodes", "max_degree", F.round(F.col("mean_slope") / 1e6, 4).alias("mean_slope"))


@query(_sql("SELECT round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM (SELECT n.node, count(d.nb) AS k FROM nodes n LEFT JOIN down d ON d.node = n.node GROUP BY n.node) GROUP BY k)", EDGES, _DOWN))
def degree_entropy(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return graphs.degree_entropy(nodes, flow.downhill(nodes, spec)).select(F.round("entropy", 6).alias("entropy"))


@query(_sql("SELECT s AS size, count(DISTINCT floor(r / s) * 1000000 + floor(c / s)) AS boxes FROM nodes, (VALUES (1), (2), (4), (8), (16)) v(s) WHERE z > 10000000000 GROUP BY s"))
def box_counts(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return graphs.box_counts(nodes.filter(F.col("z") > 10_000_000_000), spec)


_HIGH = "high AS MATERIALIZED (SELECT e.node, e.nb FROM edges e WHERE z > 5000000000 AND z_nb > 5000000000), cc(node, component) AS (SELECT node, node FROM nodes WHERE z > 5000000000 UNION SELECT h.nb, c.component FROM cc c JOIN high h ON h.node = c.node)"


@query(_sql("SELECT node, min(component) AS component FROM cc GROUP BY node", EDGES, _HIGH))
def connected_components(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    high = nodes.filter(F.col("z") > 5_000_000_000)
    return graphs.connected(neighbours(high, spec), high)


@query(_sql("SELECT node, CASE WHEN abs((c - 2) * 9 - (r - 1) * 11) / sqrt(202) <= 1.5 THEN 6 ELSE 1 END::TINYINT AS node_type FROM nodes"))
def fault_line_types(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return builder.set_where(builder.filled(nodes), builder.fault_line(spec, 1, 2, 10, 13, 1.5), B.REFLECT).select("node", "node_type")


@query(_sql("SELECT node, CASE WHEN r IN (0, ny - 1) OR c IN (0, nx - 1) THEN 0 ELSE z END AS z FROM nodes, dims"))
def zero_at_boundaries(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    coded = builder.codes(nodes, spec)
    return coded.select("node", B.at_boundaries(F.col("bc"), F.col("z"), F.lit(0)).cast("long").alias("z"))


@query(_sql("""SELECT node, least(c, r, nx - 1 - c, ny - 1 - r) AS ring, CASE WHEN r = k THEN b + c - k WHEN c = nx - 1 - k THEN b + w - 1 + r - k
  WHEN r = ny - 1 - k THEN b + w + h - 2 + nx - 1 - k - c ELSE b + 2 * (w - 1) + h - 1 + ny - 1 - k - r END AS at FROM (
  SELECT *, n - w * h AS b FROM (SELECT nodes.*, nx, ny, nx * ny AS n, least(c, r, nx - 1 - c, ny - 1 - r) AS k, nx - 2 * least(c, r, nx - 1 - c, ny - 1 - r) AS w, ny - 2 * least(c, r, nx - 1 - c, ny - 1 - r) AS h FROM nodes, dims))""".replace(" AS at FROM", " AS place FROM").replace("least(c, r, nx - 1 - c, ny - 1 - r) AS ring, CASE", "CASE")))
def spiral_order(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return traversal.spiral(nodes, spec).withColumnRenamed("at", "place")


_SEA = "sea AS MATERIALIZED (SELECT node, r, c FROM nodes WHERE z <= 8000000000), wet(node) AS (SELECT node FROM sea, dims WHERE r IN (0, ny - 1) OR c IN (0, nx - 1) UNION SELECT e.nb FROM wet w JOIN edges e ON e.node = w.node WHERE e.z_nb <= 8000000000)"


@query(_sql("SELECT n.node, w.node IS NOT NULL AS ocean FROM nodes n LEFT JOIN wet w ON w.node = n.node", EDGES, _SEA))
def ocean_labels(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return traversal.label_ocean(nodes, spec, 8e9)


@query(_sql("SELECT s.node, t.root IS NOT NULL AS mask FROM roots s LEFT JOIN (SELECT node AS root FROM area WHERE value >= 20) t USING (root)", EDGES, SFD, PATHS, ROOTS, _AREA))
def basins_by_area(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return A.basins_by_area(*_area(nodes, spec), 20)


@query(_sql("SELECT n.node, CASE WHEN b.node IS NULL THEN n.z ELSE 0 END AS z FROM nodes n LEFT JOIN (SELECT DISTINCT e.node FROM edges e JOIN roots a ON a.node = e.node JOIN roots b ON b.node = e.nb WHERE a.root <> b.root) b USING (node)", EDGES, SFD, PATHS, ROOTS))
def zero_on_divides(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    sfd = cut(flow.steepest(nodes, spec))
    marked = builder.divide_nodes(builder.filled(nodes), rivers.divides(sfd, nodes, spec))
    return marked.select("node", F.when(F.col("node_type") == B.REFLECT, 0).otherwise(F.col("z")).alias("z"))


def _rank_sql(rounds: int) -> str:
    parts = ["deg AS MATERIALIZED (SELECT node, count(*) AS k FROM down GROUP BY node)", "r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT n.node, (0.15 + 0.85 * (SELECT sum(rank) FROM r{i} WHERE node NOT IN (SELECT node FROM deg))) / (SELECT count(*) FROM nodes) + 0.85 * coalesce(s.s, 0) AS rank FROM nodes n LEFT JOIN (SELECT d.nb, sum(r.rank / deg.k) AS s FROM down d JOIN deg USING (node) JOIN r{i} r USING (node) GROUP BY d.nb) s ON s.nb = n.node)")
    return _sql(f"SELECT node, round(rank * 1e6, 6) AS rank FROM r{rounds}", EDGES, _DOWN, *parts)


@query(_rank_sql(5))
def pagerank_5(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return graphs.pagerank(cut(flow.downhill(nodes, spec)), nodes, rounds=5, tolerance=0).select("node", F.round(F.col("rank") * 1e6, 6).alias("rank"))


def _vox(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    rc = spec.with_rowcol(nodes)
    return rc.select(F.col("c").alias("x"), F.col("r").alias("y"), F.least(F.floor(F.col("z") / 2e9), F.lit(6)).cast("long").alias("z"), (F.col("z") / 1e6).alias("value"))


_VOX = "vox AS MATERIALIZED (SELECT c AS x, r AS y, least(floor(z / 2e9), 6)::BIGINT AS z, z / 1e6 AS value FROM nodes)"
_FACE = "face(a, b, d) AS (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1))"


@query(_sql("SELECT z, count(*) AS n, max(x) AS x_max, round(sum(value), 3) AS total FROM vox GROUP BY z", _VOX))
def voxel_layers(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return _vox(nodes, spec).groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("x_max"), F.round(F.sum("value"), 3).alias("total"))


@query(_sql("SELECT v.x, v.y, v.z, count(w.x) AS n FROM vox v CROSS JOIN face LEFT JOIN vox w ON w.x = v.x + a AND w.y = v.y + b AND w.z = v.z + d GROUP BY ALL", _VOX, _FACE))
def voxel_neighbour_count(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return voxels.neighbour_count(_vox(nodes, spec))


@query(_sql("SELECT x, y, z FROM vox v CROSS JOIN (VALUES (1,0),(-1,0),(0,1),(0,-1)) f(a, b) WHERE EXISTS (SELECT 1 FROM vox w WHERE w.x = v.x + a AND w.y = v.y + b AND w.z = v.z) GROUP BY ALL HAVING count(*) = 4", _VOX))
def voxel_erosion(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    cross = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0)]
    return voxels.erode(_vox(nodes, spec), kernel=cross).select("x", "y", "z")


@query(_sql("SELECT count(*) AS components, max(k) AS largest FROM (SELECT comp, count(*) AS k FROM (SELECT x, y, z, min(comp) AS comp FROM vc GROUP BY x, y, z) GROUP BY comp)", _VOX, _FACE, "vc(x, y, z, comp) AS (SELECT x, y, z, (x * 100000 + y) * 10 + z FROM vox UNION SELECT w.x, w.y, w.z, v.comp FROM vc v, face, vox w WHERE w.x = v.x + a AND w.y = v.y + b AND w.z = v.z + d)"))
def voxel_components(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    size = voxels.component_sizes(voxels.label(_vox(nodes, spec)))
    return size.agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"))


@query(_sql("SELECT count(*) AS volume, sum(6 - n)::BIGINT AS area FROM (SELECT v.x, v.y, v.z, count(w.x) AS n FROM vox v CROSS JOIN face LEFT JOIN vox w ON w.x = v.x + a AND w.y = v.y + b AND w.z = v.z + d GROUP BY ALL)", _VOX, _FACE))
def voxel_area_volume(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return voxels.area_volume(_vox(nodes, spec))


@query(_sql("""SELECT n.node, round(greatest(n.h + 0.05 * (coalesce(l.d, 0) + 0.001), 0), 6) AS h FROM wet n LEFT JOIN (
  SELECT node, sum(d) AS d FROM (SELECT node, -q AS d FROM lk UNION ALL SELECT nb, q FROM lk) GROUP BY node) l ON l.node = n.node""", EDGES,
  "wet AS MATERIALIZED (SELECT node, z / 1e9 AS z, (node % 5) / 10.0::DOUBLE AS h FROM nodes)",
  "ends AS MATERIALIZED (SELECT e.node, e.nb, a.z AS z, a.h AS h, b.z AS z_nb, b.h AS h_nb FROM edges e JOIN wet a ON a.node = e.node JOIN wet b ON b.node = e.nb WHERE e.dir IN (4, 6))",
  "lk AS MATERIALIZED (SELECT node, nb, CASE WHEN greatest(z + h, z_nb + h_nb) - greatest(z, z_nb) > 0 THEN -9.81 * (greatest(z + h, z_nb + h_nb) - greatest(z, z_nb)) * 0.05 * ((z_nb + h_nb) - (z + h)) ELSE 0 END AS q FROM ends)"))
def inertial_flood_step(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    from .flood import inertial_step

    wet = nodes.select("node", (F.col("z") / 1e9).alias("z"), ((F.col("node") % 5) / 10.0).alias("h"))
    return inertial_step(wet, None, spec, 0.05, rain=0.001)[0].select("node", F.round("h", 6).alias("h"))


@query(_sql("SELECT p.src AS node, round(n.z0 + sum(CASE WHEN s.rec = s.node THEN 0 ELSE s.dx * 100 * pow(a.value, -0.45) END), 6) AS z FROM paths p JOIN sfd s ON s.node = p.node JOIN area a ON a.node = p.node JOIN roots r ON r.node = p.src JOIN (SELECT node, z / 1e6 AS z0 FROM nodes) n ON n.node = r.root GROUP BY p.src, n.z0", EDGES, SFD, PATHS, ROOTS, _AREA))
def stream_power_step(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    sfd, area = _area(nodes, spec)
    s = sfd.join(area, "node").withColumn("_w", F.col("dx") * 100 * F.pow(F.col("value").cast("double"), F.lit(-0.45)))
    path = to_root(s, F.col("_w")).select("node", "root", "length")
    z0 = nodes.select(F.col("node").alias("root"), (F.col("z") / 1e6).alias("z0"))
    return path.join(z0, "root").select("node", F.round(F.col("z0") + F.col("length"), 6).alias("z"))


@query(_sql("SELECT node, round(chi, 6) AS value FROM (SELECT p.src AS node, sum(CASE WHEN s.rec = s.node THEN 0 ELSE s.dx * pow(1.0 / a.value, 0.2) END) AS chi FROM paths p JOIN sfd s ON s.node = p.node JOIN area a ON a.node = p.node GROUP BY p.src)", EDGES, SFD, PATHS, _AREA))
def chi_coordinate(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return rivers.chi(*_area(nodes, spec)).select("node", F.round("value", 6).alias("value"))


@query(_sql("SELECT node, round(z / 1e6 + 0.1 * coalesce(l, 0), 2) AS z FROM nodes LEFT JOIN (SELECT node, sum((z_nb / 1e6) - (z / 1e6)) AS l FROM edges WHERE dr = 0 OR dc = 0 GROUP BY node) USING (node)", EDGES))
def diffusion_step(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return terrain.diffuse(_scaled(nodes), spec, 0.1, 1.0).select("node", F.round("z", 2).alias("z"))


def _tree_sql(rounds: int) -> str:
    """Boruvka's rounds written out: labels, each label's lightest link, and what these links connect."""
    parts = ["l0 AS MATERIALIZED (SELECT node, node AS l FROM nodes)", "lks AS MATERIALIZED (SELECT node AS a, nb AS b, abs(z - z_nb) AS w FROM edges WHERE node < nb)"]
    for i in range(rounds):
        parts += [
            f"x{i} AS MATERIALIZED (SELECT a, b, w, p.l AS la, q.l AS lb FROM lks JOIN l{i} p ON p.node = a JOIN l{i} q ON q.node = b WHERE p.l <> q.l)",
            f"m{i} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY w, a, b) AS k FROM (SELECT la AS l, lb AS o, a, b, w FROM x{i} UNION ALL SELECT lb, la, a, b, w FROM x{i})) WHERE k = 1)",
            f"t{i} AS MATERIALIZED (SELECT l, o FROM m{i} UNION SELECT o, l FROM m{i})",
            f"c{i}(l, n) USING KEY (l) AS (SELECT DISTINCT l, l FROM l{i} UNION SELECT t.o, min(c.n) FROM c{i} c JOIN t{i} t ON t.l = c.l JOIN recurring.c{i} r ON r.l = t.o WHERE c.n < r.n GROUP BY t.o)",
            f"l{i + 1} AS MATERIALIZED (SELECT node, n AS l FROM l{i} JOIN c{i} USING (l))",
        ]
    return _sql(" UNION ALL ".join(f"(SELECT DISTINCT a, b, w FROM m{i})" for i in range(rounds)), EDGES, *parts)


@query(_tree_sql(16))
def minimum_spanning_tree(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    once = [(d, dr, dc) for d, dr, dc in D8 if (dr, dc) > (0, 0)]
    e = neighbours(nodes, spec, once).select("node", "nb", F.abs(F.col("z") - F.col("z_nb")).alias("w"))
    return graphs.spanning_tree(e, spec=spec)


_SHORT = "high AS MATERIALIZED (SELECT node, nb, dx FROM edges WHERE z > 2000000000 AND z_nb > 2000000000), way(node, v) USING KEY (node) AS (SELECT min(node), 0::DOUBLE FROM nodes WHERE z > 2000000000 UNION SELECT h.nb, min(w.v + h.dx) FROM way w JOIN high h ON h.node = w.node LEFT JOIN recurring.way o ON o.node = h.nb WHERE o.v IS NULL OR w.v + h.dx < o.v - 1e-9 GROUP BY h.nb)"


@query(_sql("SELECT node, round(v, 6) AS value FROM way", EDGES, _SHORT))
def shortest_path_lengths(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    high = nodes.filter(F.col("z") > 2_000_000_000)
    start = high.agg(F.min("node")).first()[0]
    return graphs.shortest_paths(neighbours(high, spec), start, spec=spec).select("node", F.round("value", 6).alias("value"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["drainage_area_sfd"](spark, sf_dir)
