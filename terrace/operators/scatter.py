"""From returns to cells: binning, the per-cell reduction of a frame, and reductions like it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace import config as C
from terrace.functions import lattice as L
from terrace.functions import measure as M
from terrace.functions.sphere import range_m

CELL = ["ring", "ix", "iy"]


def binned(points: DataFrame, s: C.Schedule, xw: str = "x", yw: str = "y", speed: Column | None = None, ego: tuple[Column, Column] | None = None) -> DataFrame:
    """Adds ring, ix, iy; drops returns outside the map, and with `ego` those outside the ring's window around it."""
    x, y = F.col("x"), F.col("y")
    at = L.with_cells(points.where(L.in_map(x, y, s)), s, F.col(xw), F.col(yw), L.ring_of(x, y, s, speed))
    if ego is not None:
        # by a generator: the window's test is not moved before it, where it would copy the formulas of ring and cell many times
        at = at.select(*points.columns, F.inline(F.array(F.struct(*CELL))))
        for i, e in zip(("ix", "iy"), ego, strict=True):
            at = at.where(L.in_window(F.col(i), L.window_start(e, F.col("ring"), s), F.col("ring"), s))
    return at


def measured(points: DataFrame, sensor_range: Column | None = None) -> DataFrame:
    """Adds z_cm, w_q and refl, the fixed-point measurement of a return."""
    r = range_m(F.col("x"), F.col("y"), F.col("z")) if sensor_range is None else sensor_range
    refl = F.least(F.greatest(F.rint(F.col("intensity") * 255.0), F.lit(0.0)), F.lit(255.0)).cast("int")
    return points.withColumns({"z_cm": M.height_cm(F.col("z")), "w_q": M.weight(M.variance_cm2(r)), "refl": refl})


def scatter(cells: DataFrame, by: list[str]) -> DataFrame:
    """Per cell: fixed-point height and weight sums of ground returns, count, ceiling of the others, reflectivity sum, class of the first return.

    Integer sums, minima and the class by smallest point_id do not depend on how rows are
    partitioned; partial aggregation runs before the one shuffle.
    """
    ground = F.col("ground")
    big = lambda c: c.cast("bigint")
    return cells.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(ground, big(F.col("w_q")) * F.col("z_cm"))), F.lit(0)).alias("wz_sum"),
        F.coalesce(F.sum(F.when(ground, big(F.col("w_q")))), F.lit(0)).alias("w_sum"),
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.min(F.when(~ground, F.col("z_cm"))), F.lit(C.NO_CEILING)).alias("ceiling_cm"),
        F.sum(big(F.col("refl"))).alias("refl_sum"),
        F.min(F.struct("point_id", "cls"))["cls"].alias("class_id"),
    )


def frame_cells(points: DataFrame, s: C.Schedule = C.FOVEATED) -> DataFrame:
    """The aggregate of every frame's cells, with the mean height and whether ground was seen."""
    out = scatter(measured(binned(points, s)), ["frame", *CELL])
    return out.withColumns({"mean_cm": M.mean_height(F.col("wz_sum"), F.col("w_sum")), "has_ground": F.col("w_sum") > 0})


def transient_cells(points: DataFrame, s: C.Schedule = C.FOVEATED) -> DataFrame:
    """Cells of moving returns, frame by frame: the highest one's height (0 at least) and the dynamic flag."""
    cells = measured(binned(points.where("moving"), s)).groupBy("frame", *CELL)
    return cells.agg(F.greatest(F.max("z_cm"), F.lit(0)).alias("ground_cm")).withColumn("flags", F.lit(C.FLAG_DYNAMIC))


def clusters(points: DataFrame, cell_m: float = 1.0) -> DataFrame:
    """Moving returns by squares of cell_m: centroid, top, class of the first return."""
    key = [F.floor(F.col(c) / cell_m).cast("bigint").alias(k) for c, k in (("x", "cx"), ("y", "cy"))]
    return points.where("moving").groupBy("frame", *key).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.max("z").alias("z_max"), F.min(F.struct("point_id", "cls"))["cls"].alias("class_id"), F.count(F.lit(1)).alias("n"))


def uniform_baseline(points: DataFrame, cell_m: float = 0.05) -> DataFrame:
    """A grid of one cell size: count up to 255 and the last return's height."""
    i = [F.floor(F.col(c) / cell_m).cast("bigint").alias(k) for c, k in (("x", "ix"), ("y", "iy"))]
    return points.groupBy(*i).agg(F.least(F.count(F.lit(1)), F.lit(255)).alias("n"), F.max(F.struct("frame", "point_id", "z"))["z"].alias("z"))


def dense_voxels(points: DataFrame, cell_m: float = 0.05, z_min: float = -2.0, layers: int = 160) -> DataFrame:
    """Occupied voxels of a dense grid."""
    v = points.select(*(F.floor(F.col(c) / cell_m).cast("bigint").alias(k) for c, k in (("x", "ix"), ("y", "iy"))), F.floor((F.col("z") - z_min) / cell_m).cast("bigint").alias("iz"))
    return v.where(F.col("iz").between(0, layers - 1)).distinct()


def map_digest(cells: DataFrame) -> DataFrame:
    """One row that tells two maps apart, whatever the order of their rows."""
    h = F.xxhash64(*sorted(cells.columns))
    return cells.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("xor"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("sum"))
