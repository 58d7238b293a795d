"""Surfaces from streams: measurements of nodes become a running surface and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.grids import columns_of


def measurements(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files like ``events``: node, ts, value."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.select(F.col("event_id").alias("node"), "ts", "value")


def running_surface(stream: DataFrame) -> DataFrame:
    """node, z (mean of all measurements so far), n: state by node, emitted when it changes (update mode)."""
    return stream.groupBy("node").agg(F.avg("value").alias("z"), F.count(F.lit(1)).alias("n"))


def windowed_rows(stream: DataFrame, nodes: int, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """start, r, n, z_max by window and row of the grid; a window is final once the watermark has passed it."""
    row = F.floor(F.col("node") / columns_of(nodes)).cast("long")
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), row.alias("r"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("z_max")).select(F.col("w.start").alias("start"), "r", "n", "z_max")
