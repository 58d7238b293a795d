"""Queries against their SQL over grids whose last row is not full, and over ones of several tiles."""

import duckdb
import pandas as pd
import pytest

from talweg import scratch
from talweg.operators import depressions, parts, voxels, voxelways
from talweg.plans import forms  # noqa: F401  registers its queries
from talweg.plans.queries import QUERIES, SQL

EVENTS = "/root/testdata/sf0.001/events.parquet"


def agrees(spark, tmp_path, name, copies):
    """Compare a query with its SQL over a number of copies of the events, with shifted keys."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT event_id + 1000 * i AS event_id, ts, user_id, event_type, value, props FROM '{EVENTS}', range(0, {copies}) t(i) ORDER BY hash(event_id * 7 + i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(SQL[name]).df()
    columns = sorted(want.columns)
    a, b = (x[columns].sort_values(columns, ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=1e-6)


def test_smoothed_types_where_the_last_row_is_not_full(spark, tmp_path):
    agrees(spark, tmp_path, "smoothed_types", 3)


BY_TILES = ["filled_surface", "reconstructed_surface", "draining_fill", "rerouted_receivers", "rerouted_receivers_fill", "breadth_first_steps", "ocean_labels", "shortest_path_lengths", "rain_discharge", "mfd_with_loss", "voxel_distance_steps"]


@pytest.mark.parametrize("name", BY_TILES)
def test_by_tiles(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(parts.tile_of, "__defaults__", (16,))
    monkeypatch.setattr(depressions, "DRIVER_PASSES", 0)
    monkeypatch.setattr(voxels, "BLOCK", 16)
    tables = []
    monkeypatch.setattr(scratch, "scratch_path", lambda s, path=scratch.scratch_path: tables.append(path(s)) or tables[-1])
    agrees(spark, tmp_path, name, 1)
    assert len(tables) < 90  # a few rounds each: steps along a way are no rounds of their own


@pytest.mark.parametrize("name, copies", [("voxel_shortest_route", 1), ("voxel_separate_routes", 3)])
def test_voxel_ways(spark, tmp_path, monkeypatch, name, copies):
    monkeypatch.setattr(voxelways, "PLACES", 700)
    agrees(spark, tmp_path, name, copies)
