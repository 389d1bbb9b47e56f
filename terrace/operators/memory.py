"""What maps cost in bytes, in closed form and as stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace import config as C
from terrace.config import THRESHOLDS, Schedule
from terrace.operators.pyramid import level_sides


def budget(spark: SparkSession, s: Schedule = C.FOVEATED) -> DataFrame:
    """item, units, bytes of a map of that schedule: logical cells, stored squares, transient layer, pool, tracks, pyramid."""
    slots = sum(r.side ** 2 for r in s.bands)
    logical = sum(r.cells for r in s.bands)
    nodes = sum(n * n for r in s.bands for n in level_sides(r.side)[1:])
    pool = THRESHOLDS.pool_blocks * THRESHOLDS.pool_cells
    rows = [
        ("logical cells", logical, logical * C.CELL_BYTES), ("stored cells", slots, slots * C.CELL_BYTES), ("transient", slots, slots * C.TRANSIENT_BYTES),
        ("pool", pool, pool * C.CELL_BYTES), ("tracks", THRESHOLDS.track_capacity, THRESHOLDS.track_capacity * C.TRACK_BYTES), ("pyramid", nodes, nodes * C.NODE_BYTES),
    ]
    return spark.createDataFrame(rows, "item string, units bigint, bytes bigint")


def baselines(spark: SparkSession, s: Schedule = C.FOVEATED, footprint_m: float = 200.0, vertical_m: float = 8.0) -> DataFrame:
    """name, units, bytes, ratio of one dense voxel grid and one uniform grid to the schedule's logical cells."""
    side = round(footprint_m / s.unit_m)
    ours = sum(r.cells for r in s.bands) * C.CELL_BYTES
    dense, flat = side * side * round(vertical_m / s.unit_m), side * side
    rows = [("dense voxels", dense, dense), ("uniform cells", flat, flat * C.CELL_BYTES)]
    return spark.createDataFrame(rows, "name string, units bigint, bytes bigint").withColumn("ratio", F.col("bytes") / ours)


def live_bytes(cells: DataFrame) -> DataFrame:
    """ring, cells, bytes of the cells that were ever seen."""
    return cells.where("obs_count > 0").groupBy("ring").agg(F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * C.CELL_BYTES).alias("bytes"))


def latency(timings: DataFrame, by: str, value: str) -> DataFrame:
    """p50, p99 (the value at the next higher rank), max and headroom against 100 of each stage; equal values are counted before they are ranked."""
    counts = timings.groupBy(by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(by).orderBy("v")
    ranked = counts.withColumns({"upto": F.sum("c").over(order), "n": F.sum("c").over(Window.partitionBy(by))})
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(q * (F.col("n") - 1)) + 1, F.col("v")))
    return ranked.groupBy(by).agg(at(0.5).alias("p50"), at(0.99).alias("p99"), F.max("v").alias("max")).withColumn("headroom", 100.0 / F.col("p50"))
