"""The live map: frame after frame the window moves, heights keep to a band around the vehicle, returns are fused, and cells that the sensor sees through lose their occupancy.

A map is a table of cell states. One step is a handful of joins on the cell, in parallel over
all cells; only frames follow one another. Each step's state is a table in the scratch
folder, so the lineage of a long run stays short.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace import config as C
from terrace.config import THRESHOLDS, Schedule, Thresholds
from terrace.functions import lattice as L
from terrace.functions import measure as M
from terrace.operators import perception
from terrace.operators.fold import MEASURED, STATE, merge_frame, rebase
from terrace.operators.scatter import CELL, binned, measured, scatter
from terrace.scratch import drop_folder, drop_written, scratch_path, written

#: Whole steps in which the height band follows the vehicle.
DATUM_STEP_M = 1.0
STATE_SCHEMA = "ring int, ix bigint, iy bigint, " + ", ".join(f"{n} {t}" for n, t, _ in STATE)
COUNTERS = "frame int, cells_touched bigint, occupied bigint, tested bigint, cleared bigint, protected bigint, out_of_view bigint"
COLUMNS = [c.split()[0] for c in COUNTERS.split(", ")]


@dataclass(frozen=True)
class Pose:
    """Where the vehicle stands in a frame, in the world."""

    frame: int
    x: float
    y: float
    z: float = 0.0

    @property
    def datum(self) -> float:
        return math.floor(self.z / DATUM_STEP_M) * DATUM_STEP_M


def poses_of(transforms: DataFrame) -> list[Pose]:
    """The poses of a sequence (frame, t: vehicle to world), one row a frame, in order."""
    return [Pose(r.frame, r.t[3], r.t[7], r.t[11]) for r in transforms.orderBy("frame").collect()]


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE_SCHEMA)


def shifted(state: DataFrame, pose: Pose, s: Schedule = C.FOVEATED) -> DataFrame:
    """The cells that the rings' windows around the vehicle still hold; a cell that left starts anew."""
    for i, at in (("ix", pose.x), ("iy", pose.y)):
        state = state.where(L.in_window(F.col(i), L.window_start(F.lit(float(at)), F.col("ring"), s), F.col("ring"), s))
    return state


def followed(state: DataFrame, old: float, new: float) -> DataFrame:
    """Heights against a moved datum; a ceiling that was never seen stays unseen."""
    if old == new:
        return state
    move = lambda c: rebase(F.col(c), F.lit(old), F.lit(new)).cast("int")
    return state.withColumns({"ground_cm": move("ground_cm"), "ceiling_cm": F.when(F.col("ceiling_cm") == C.NO_CEILING, C.NO_CEILING).otherwise(move("ceiling_cm"))})


def guarded(cls: Column, clip: bool = False) -> Column:
    """A class that five bits hold: none is 0; larger ones are clipped, or raise, since they are raw labels rather than classes."""
    known = F.greatest(F.coalesce(cls, F.lit(0)), F.lit(0))
    if clip:
        return F.least(known, F.lit(C.UNLABELLED)).cast("int")
    return F.when(known > C.UNLABELLED, F.raise_error(F.lit("a class above 31: raw labels where classes are expected")).cast("int")).otherwise(known).cast("int")


def aggregated(points: DataFrame, pose: Pose, s: Schedule = C.FOVEATED, clip_classes: bool = False) -> DataFrame:
    """The frame's aggregate of each cell within the windows. points: x, y, z as the sensor sees them, xw, yw, zw in the world; rings and ranges follow the first, cells and heights the second."""
    at = binned(points, s, "xw", "yw", ego=(F.lit(float(pose.x)), F.lit(float(pose.y)))).withColumn("cls", guarded(F.col("cls"), clip_classes))
    high = measured(at).withColumn("z_cm", M.height_cm(F.col("zw"), F.lit(pose.datum)))
    return scatter(high, ["frame", *CELL])


def aggregated_steps(points: DataFrame, poses: list[Pose], s: Schedule = C.FOVEATED, clip_classes: bool = False) -> DataFrame:
    """The aggregates of aggregated() for every pose in one pass over the returns: a folder for each step (the pose's place in the list). They depend on no state, and a frame has no more of them than its windows have cells."""
    spark = points.sparkSession
    rows = [(n, p.frame, float(p.x), float(p.y), p.datum) for n, p in enumerate(poses)]
    at = points.join(F.broadcast(spark.createDataFrame(rows, "step int, frame int, __x double, __y double, __datum double")), "frame")
    at = binned(at, s, "xw", "yw", ego=(F.col("__x"), F.col("__y"))).withColumn("cls", guarded(F.col("cls"), clip_classes))
    found = scatter(measured(at).withColumn("z_cm", M.height_cm(F.col("zw"), F.col("__datum"))), ["step", "frame", *CELL])
    path = scratch_path(spark, "steps")
    found.write.partitionBy("step").parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def see_through(state: DataFrame, points: DataFrame, touched: DataFrame, pose: Pose, s: Schedule = C.FOVEATED, th: Thresholds = THRESHOLDS) -> DataFrame:
    """The test of perception.seen_through() on the map's occupied cells, against the frame's own range image."""
    there = perception.occupied_in_frame(state.withColumn("frame", F.lit(pose.frame)), F.lit(float(pose.x)), F.lit(float(pose.y)), s)
    there = there.withColumn("z", F.col("z") + F.lit(pose.datum - pose.z))
    return perception.seen_through(there, perception.range_image(points, th), touched, th)


TESTS = ("in_view", "see_through", "protected")


def fuse(state: DataFrame, points: DataFrame, pose: Pose, datum: float, s: Schedule = C.FOVEATED, th: Thresholds = THRESHOLDS, clip_classes: bool = False, aggregate: DataFrame | None = None) -> DataFrame:
    """The cells after one frame's returns. datum: of the state before. points: the frame's own. aggregate: theirs, where it is there already."""
    moved = followed(shifted(state, pose, s), datum, pose.datum)
    return merge_frame(moved, aggregated(points, pose, s, clip_classes) if aggregate is None else aggregate, th)


def seen(fused: DataFrame, points: DataFrame, pose: Pose, s: Schedule = C.FOVEATED, th: Thresholds = THRESHOLDS) -> DataFrame:
    """The fused cells with what the test for seeing through them says, nulls for cells that are not occupied; reads fused twice."""
    touched = fused.where(F.col("last_frame") == pose.frame).select(F.lit(pose.frame).alias("frame"), *CELL)
    return fused.join(see_through(fused, points, touched, pose, s, th).select(*CELL, *TESTS), CELL, "left")


def step(state: DataFrame, points: DataFrame, pose: Pose, datum: float, s: Schedule = C.FOVEATED, th: Thresholds = THRESHOLDS, cleanup: bool = True, clip_classes: bool = False, aggregate: DataFrame | None = None) -> DataFrame:
    """One frame: a table in the scratch folder that state_of() and counters_of() read. Arguments as in fuse(). The table between fusing and testing is deleted."""
    fused = fuse(state, points, pose, datum, s, th, clip_classes, aggregate)
    if not cleanup:
        return written(fused.withColumns({n: F.lit(None).cast("boolean") for n in TESTS}), "live")
    fused = written(fused, "fused")
    after = written(seen(fused, points, pose, s, th), "live")
    drop_written(fused)
    return after


def state_of(cells: DataFrame, th: Thresholds = THRESHOLDS) -> DataFrame:
    """The state after a step: a miss at every cell that was seen through."""
    through = F.coalesce("see_through", F.lit(False))
    return cells.withColumn("log_odds", perception.miss(F.col("log_odds"), through, th).cast("int")).drop(*TESTS)


def counters_of(cells: DataFrame, frame: int) -> DataFrame:
    """One row of COUNTERS of a step."""
    tested = F.count("in_view")
    return cells.agg(
        F.count_if(F.col("last_frame") == frame).alias("cells_touched"), tested.alias("occupied"), tested.alias("tested"), F.count_if("see_through").alias("cleared"),
        F.count_if("protected").alias("protected"), F.count_if(~F.col("in_view")).alias("out_of_view"),
    ).select(F.lit(frame).alias("frame"), *COLUMNS[1:])


def run(points: DataFrame, poses: Iterable[Pose], s: Schedule = C.FOVEATED, th: Thresholds = THRESHOLDS, cleanup: bool = True, clip_classes: bool = False) -> tuple[DataFrame, DataFrame]:
    """The map after all frames in order, and one row of counters a frame. Frames without returns move the window and the band all the same.

    The returns are reduced to cells in one pass for all frames; only the test for seeing through cells reads a frame's returns again.
    """
    spark, poses = points.sparkSession, list(poses)
    cells, datum, counters = None, None, None
    steps = aggregated_steps(points, poses, s, clip_classes)
    for n, pose in enumerate(poses):
        state = empty(spark) if cells is None else state_of(cells, th)
        after = step(state, points.where(F.col("frame") == pose.frame), pose, pose.datum if datum is None else datum, s, th, cleanup, clip_classes, steps.where(F.col("step") == n))
        one, datum = counters_of(after, pose.frame), pose.datum
        counters = [*(counters or ()), one.first()]
        if cells is not None:
            drop_written(cells)
        cells = after
    drop_folder(steps)
    rows = spark.createDataFrame([tuple(c) for c in counters or ()], COUNTERS)
    return (empty(spark) if cells is None else state_of(cells, th)), rows


def transient_step(points: DataFrame, s: Schedule = C.FOVEATED) -> tuple[DataFrame, DataFrame]:
    """The transient layer of each frame, made anew, and the detections that tracking takes: seq, frame, det, x, y, class_id."""
    from terrace.operators.scatter import clusters, transient_cells

    found = clusters(points)
    detections = found.select(F.lit("live").alias("seq"), "frame", F.row_number().over(_by_cluster()).alias("det"), "x", "y", F.col("class_id").cast("int").alias("class_id"))
    return transient_cells(points, s), detections


def _by_cluster():
    from pyspark.sql import Window

    return Window.partitionBy("frame").orderBy("cx", "cy")


def removal(points: DataFrame, cleaned: DataFrame, kept: DataFrame, s: Schedule = C.FOVEATED) -> DataFrame:
    """removed, dynamic, preserved, static and DR, SP, F of a map with cleanup against the one without.

    Dynamic cells are those that only moving returns ever fell into, static ones those that
    no moving return did; both as far as the map without cleanup calls them occupied.
    points: as in aggregated().
    """
    from terrace.operators.reference import dynamic_removal

    cells = binned(points, s, "xw", "yw").groupBy(*CELL).agg(F.bool_and("moving").alias("dynamic"), F.bool_or("moving").alias("any"))
    occupied = lambda m: m.where(M.occupancy(F.col("obs_count"), F.col("log_odds"), F.col("flags")) == C.OCCUPIED).select(*CELL)
    there = occupied(kept).join(cells, CELL).join(occupied(cleaned).withColumn("still", F.lit(True)), CELL, "left").withColumn("still", F.coalesce("still", F.lit(False)))
    n = there.agg(F.count_if(F.col("dynamic") & ~F.col("still")).alias("removed"), F.count_if("dynamic").alias("dynamic"), F.count_if(~F.col("any") & F.col("still")).alias("preserved"), F.count_if(~F.col("any")).alias("static"))
    return n.select("*", dynamic_removal(F.col("removed"), F.col("dynamic"), F.col("preserved"), F.col("static")).alias("r")).select("removed", "dynamic", "preserved", "static", "r.*")


def trail(cells: DataFrame, x_from: float, x_to: float, y: float, half_m: float, s: Schedule = C.FOVEATED) -> DataFrame:
    """Occupied cells in the lane that something swept, behind where it is now: it, or ghosts of it."""
    from terrace.operators.query import occupied_cells

    return occupied_cells(cells, s).where((F.abs(F.col("y") - y) <= half_m) & F.col("x").between(x_from, x_to))


def compare(points: DataFrame, poses: list[Pose], schedules: Iterable[Schedule], ref: DataFrame, th: Thresholds = THRESHOLDS) -> DataFrame:
    """schedule, cells, bytes and all scores by ring: the same static frames folded into a map of each schedule, each held against the reference map (world heights in cm)."""
    from terrace.operators.reference import evaluate

    rows, static = None, points.where(~F.col("moving"))
    for s in schedules:
        state, _ = run(static, poses, s, th, cleanup=False)
        cells = sum(b.cells for b in s.bands)
        last = poses[-1]
        scores = evaluate(followed(state, last.datum, 0.0), ref, s, (last.x, last.y)).select(F.lit(s.name).alias("schedule"), F.lit(cells).cast("bigint").alias("cells"), F.lit(cells * C.CELL_BYTES).cast("bigint").alias("bytes"), "*")
        rows = scores if rows is None else rows.unionByName(scores)
    return rows


def memory_and_regret(schedule: Schedule, regrets: DataFrame) -> DataFrame:
    """schedule, bytes, n, regret (mean over queries that are not blocked), blocked: one row of the table of memory against regret. regrets: of planning.regret(), one map's."""
    cells = sum(b.cells for b in schedule.bands)
    figures = regrets.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(~F.col("blocked"), F.col("regret"))).alias("regret"), F.count_if("blocked").alias("blocked"))
    return figures.select(F.lit(schedule.name).alias("schedule"), F.lit(cells * C.CELL_BYTES).cast("bigint").alias("bytes"), "n", "regret", "blocked")
