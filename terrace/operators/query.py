"""Point and region queries on a map, and the union with what moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace import config as C
from terrace.config import Schedule
from terrace.functions import lattice as L
from terrace.functions import measure as M
from terrace.operators.scatter import CELL, binned


def at_points(points: DataFrame, cells: DataFrame, s: Schedule = C.FOVEATED, transient: DataFrame | None = None, refined: DataFrame | None = None) -> DataFrame:
    """What the map says at each point: one row a point.

    points: query_id, x, y in the vehicle frame. cells: state with trav. transient: cells of
    what moves now, which win. refined: ring, ix, iy, child and the state of split cells,
    child counting along x, then y. Outside the map heights are null, trav is low confidence,
    occupancy unknown.
    """
    asked = L.with_cells(points, s, F.col("x"), F.col("y"), L.ring_of(F.col("x"), F.col("y"), s))
    fields = ["ground_cm", "ceiling_cm", "class_byte", "trav", "obs_count", "log_odds", "flags"]
    found = asked.join(cells.select(*CELL, F.struct(*fields).alias("own")), CELL, "left")
    if refined is not None:
        fine = L.by_ring(F.col("ring"), [1, *(s.split(r.number) for r in s.bands[1:])]).cast("bigint")
        inner = lambda c, i: L.cell_index(F.col(c), F.greatest(F.col("ring") - 1, F.lit(0)), s) - F.col(i) * fine
        found = found.withColumn("child", (inner("y", "iy") * fine + inner("x", "ix")).cast("int"))
        found = found.join(refined.select(*CELL, "child", F.struct(*fields).alias("fine")), [*CELL, "child"], "left").withColumn("own", F.coalesce("fine", "own"))
    found = found.withColumn("moving_cm", F.lit(None).cast("int")) if transient is None else found.join(transient.select(*CELL, F.col("ground_cm").alias("moving_cm")), CELL, "left")
    out, own = F.col("ring") < 0, lambda n, empty: F.coalesce(F.col(f"own.{n}"), F.lit(empty))
    dynamic = F.col("moving_cm").isNotNull()
    state = M.occupancy(own("obs_count", 0), own("log_odds", 0), own("flags", 0))
    return found.select(
        "query_id",
        F.when(~out, F.coalesce(F.col("moving_cm"), own("ground_cm", 0)) / 100.0).alias("ground_m"),
        F.when(~out, own("ceiling_cm", C.NO_CEILING) / 100.0).alias("ceiling_m"),
        F.when(out, 0).otherwise(M.candidate(own("class_byte", 0))).alias("semantic_class"),
        F.when(out, C.TRAV_CONFIDENCE).otherwise(own("trav", C.TRAV_CONFIDENCE | C.TRAV_CLASS | C.TRAV_ROUGHNESS)).alias("trav"),
        F.when(out, 0).otherwise(own("obs_count", 0)).alias("n"),
        F.when(out, C.UNKNOWN).when(dynamic, C.OCCUPIED).otherwise(state).alias("occupancy"),
        (~out & dynamic).alias("dynamic"),
    )


def is_traversable() -> Column:
    """On the result of at_points."""
    return (F.col("occupancy") != C.UNKNOWN) & ~F.col("dynamic") & (F.col("trav") == 0)


def is_free() -> Column:
    return F.col("occupancy") == C.FREE


def occupied_cells(cells: DataFrame, s: Schedule = C.FOVEATED) -> DataFrame:
    """ring, ix, iy, world centre and height of occupied cells: the ceiling's where one was seen, else the ground's."""
    there = cells.where(M.occupancy(F.col("obs_count"), F.col("log_odds"), F.col("flags")) == C.OCCUPIED)
    z = F.when(F.col("ceiling_cm") != C.NO_CEILING, F.col("ceiling_cm")).otherwise(F.col("ground_cm")) / 100.0
    return there.select(*CELL, L.centre(F.col("ix"), F.col("ring"), s).alias("x"), L.centre(F.col("iy"), F.col("ring"), s).alias("y"), z.alias("z"))


def ghosts(points: DataFrame, cells: DataFrame, now: int, s: Schedule = C.FOVEATED) -> DataFrame:
    """Occupied cells that something moved through before, and nothing does in frame `now`."""
    moving = binned(points.where("moving"), s)
    ever = moving.select(*CELL).distinct()
    current = moving.where(F.col("frame") == now).select(*CELL).distinct()
    return ever.join(current, CELL, "left_anti").join(occupied_cells(cells, s).select(*CELL), CELL, "left_semi")


def resampled(cells: DataFrame, cell_m: float, s: Schedule = C.FOVEATED) -> DataFrame:
    """The map on one uniform lattice: count-weighted heights of the cells whose centres fall into each cell."""
    i = [F.floor(L.centre(F.col(c), F.col("ring"), s) / cell_m).cast("bigint").alias(k) for c, k in (("ix", "i"), ("iy", "j"))]
    n = F.col("obs_count").cast("bigint")
    return cells.where("obs_count > 0").groupBy(*i).agg(F.sum(n).alias("n"), M.mean_height(F.sum(n * F.col("ground_cm")), F.sum(n)).alias("ground_cm"))


def bind(cells: DataFrame, name: str = "live_map") -> None:
    """Gives the map a name for SQL and for bound()."""
    cells.createOrReplaceTempView(name)


def bound(spark: SparkSession, name: str = "live_map") -> DataFrame:
    return spark.table(name)


def display_sets(cells: DataFrame, s: Schedule = C.FOVEATED) -> DataFrame:
    """shown (occupied, free, or unknown although observed), ring, ix, iy, world centre and height of every cell."""
    state = M.occupancy(F.col("obs_count"), F.col("log_odds"), F.col("flags"))
    z = F.when(F.col("ceiling_cm") != C.NO_CEILING, F.col("ceiling_cm")).otherwise(F.col("ground_cm")) / 100.0
    shown = F.when(state == C.OCCUPIED, "occupied").when(state == C.FREE, "free").otherwise("unknown")
    return cells.select(shown.alias("shown"), *CELL, L.centre(F.col("ix"), F.col("ring"), s).alias("x"), L.centre(F.col("iy"), F.col("ring"), s).alias("y"), z.alias("z"))


def box_counts(cells: DataFrame, points: DataFrame, x: tuple[float, float], y: tuple[float, float], s: Schedule = C.FOVEATED, cell_m: float = 0.05) -> DataFrame:
    """ours, dense: occupied cells of the map in a crop, and occupied voxels of a dense grid of cell_m there."""
    from terrace.operators.scatter import dense_voxels

    inside = F.col("x").between(*x) & F.col("y").between(*y)
    ours = occupied_cells(cells, s).where(inside).agg(F.count(F.lit(1)).alias("ours")).withColumn("one", F.lit(1))
    dense = dense_voxels(points.where(inside), cell_m).agg(F.count(F.lit(1)).alias("dense")).withColumn("one", F.lit(1))
    return ours.join(dense, "one").drop("one")
