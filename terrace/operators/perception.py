"""Range images: projection, normals and reflectivity, gaps, visibility, motion between frames, moving instances."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace import config as C
from terrace.config import THRESHOLDS, Schedule, Thresholds
from terrace.functions import lattice as L
from terrace.functions import measure as M
from terrace.functions import sphere as S
from terrace.operators.scatter import CELL

GRAZING, NO_NORMAL = 1, 2
PIXEL = ["frame", "v", "u"]


def with_pixels(points: DataFrame, th: Thresholds = THRESHOLDS) -> DataFrame:
    """Adds r, v_raw (may lie outside the image), v, u."""
    out = points.withColumn("r", S.range_m(F.col("x"), F.col("y"), F.col("z")))
    return out.withColumns({"v_raw": S.elevation_bin(F.col("z"), F.col("r"), th), "u": S.azimuth_bin(F.col("x"), F.col("y"), th)}).withColumn("v", S.clamp_bin(F.col("v_raw"), th))


def range_image(points: DataFrame, th: Thresholds = THRESHOLDS) -> DataFrame:
    """frame, v, u and the closest return of each pixel, the first of equally close ones; pixels without a return have no row."""
    near = F.min(F.struct("r", "point_id", "x", "y", "z", "intensity", "moving")).alias("p")
    return with_pixels(points, th).where("r > 1e-6").groupBy(*PIXEL).agg(near).select(*PIXEL, "p.*")


def projection_stats(points: DataFrame, th: Thresholds = THRESHOLDS) -> DataFrame:
    """Per frame: returns, those of no range, those clamped above and below, pixels filled, and both shares."""
    some = F.col("r") > 1e-6
    stats = with_pixels(points, th).groupBy("frame").agg(
        F.count(F.lit(1)).alias("n_input"), F.count_if(~some).alias("n_zero_range"), F.count_if(some & (F.col("v_raw") < 0)).alias("n_clamped_above"),
        F.count_if(some & (F.col("v_raw") >= th.rings)).alias("n_clamped_below"), F.count_distinct(F.when(some, F.struct("v", "u"))).alias("n_pixels"),
    )
    return stats.withColumns({"fill": F.col("n_pixels") / (th.rings * th.azimuths), "out_of_view": (F.col("n_clamped_above") + F.col("n_clamped_below")) / F.col("n_input")})


def _pixels_at(image: DataFrame, wanted: dict[str, tuple[Column, Column]], values: list[str]) -> DataFrame:
    """Adds a struct of the values at other pixels of the frame; one join and one aggregation for all."""
    asked = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), v.cast("int").alias("v"), u.cast("int").alias("u")) for n, (v, u) in wanted.items()))).alias("q")
    requests = image.select(*PIXEL, asked).select("frame", F.col("q.v").alias("nv"), F.col("q.u").alias("nu"), "v", "u", "q.name")
    there = image.select("frame", F.col("v").alias("nv"), F.col("u").alias("nu"), F.struct(*values).alias("p"))
    answers = requests.join(there, ["frame", "nv", "nu"]).groupBy(*PIXEL).agg(*(F.max(F.when(F.col("name") == n, F.col("p"))).alias(n) for n in wanted))
    return image.join(answers, PIXEL, "left")


def incidence(image: DataFrame, th: Thresholds = THRESHOLDS) -> DataFrame:
    """Adds cos_inc, the cosine between beam and surface normal; null where a neighbour is missing. Azimuth wraps, elevation does not."""
    u, v, w = F.col("u"), F.col("v"), th.azimuths
    near = _pixels_at(image, {"e": (v, F.pmod(u + 1, F.lit(w))), "w": (v, F.pmod(u - 1, F.lit(w))), "n": (v + 1, u), "s": (v - 1, u)}, ["x", "y", "z"])
    a = [F.col(f"e.{c}") - F.col(f"w.{c}") for c in "xyz"]
    b = [F.col(f"n.{c}") - F.col(f"s.{c}") for c in "xyz"]
    normal = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    length = F.sqrt(normal[0] * normal[0] + normal[1] * normal[1] + normal[2] * normal[2])
    dot = normal[0] * F.col("x") + normal[1] * F.col("y") + normal[2] * F.col("z")
    return near.withColumn("length", length).withColumn("cos_inc", F.when(F.col("length") > 1e-6, F.abs(dot) / (F.col("length") * F.col("r")))).drop(*"ewns", "length")


def reflectivity(image: DataFrame, th: Thresholds = THRESHOLDS, by_range: bool = False, by_incidence: bool = False, full_scale: float | None = None) -> DataFrame:
    """Adds rho8 (0 to 255) and flags; optionally compensated for range and for the angle of incidence."""
    cos = F.col("cos_inc")
    rho = F.col("intensity").cast("double")
    rho = rho * F.col("r") * F.col("r") if by_range else rho
    rho = rho / F.greatest(cos, F.lit(0.1)) if by_incidence else rho
    scale = full_scale or (4000.0 if by_range or by_incidence else 1.0)
    byte = F.least(F.greatest(F.rint(rho / scale * 255.0), F.lit(0.0)), F.lit(255.0)).cast("int")
    flags = F.when(cos.isNull(), NO_NORMAL).when(cos < 0.1, GRAZING).otherwise(0)
    return incidence(image, th).withColumns({"rho8": F.coalesce(byte, F.lit(0)), "flags": flags})


def back_to_points(points: DataFrame, image: DataFrame) -> DataFrame:
    """Every return with its pixel's rho8 and flags if it is the one that the pixel shows, else 0 and no normal."""
    shown = image.select("frame", "point_id", "rho8", "flags")
    return points.join(shown, ["frame", "point_id"], "left").withColumns({"rho8": F.coalesce("rho8", F.lit(0)), "flags": F.coalesce("flags", F.lit(NO_NORMAL))})


def filled_gaps(image: DataFrame, th: Thresholds = THRESHOLDS) -> DataFrame:
    """frame, v, u, r of pixels without a return between two that have one: the mean of both."""
    right = image.where(F.col("u") < th.azimuths - 1).select("frame", "v", (F.col("u") + 1).alias("u"), F.col("r").alias("left_r"))
    left = image.where(F.col("u") > 0).select("frame", "v", (F.col("u") - 1).alias("u"), F.col("r").alias("right_r"))
    return right.join(left, PIXEL).join(image.select(*PIXEL), PIXEL, "left_anti").select(*PIXEL, ((F.col("left_r") + F.col("right_r")) / 2.0).alias("r"))


def network_input(image: DataFrame) -> DataFrame:
    """The image's channels scaled to what a network takes: range and coordinates by 100 m, intensity by 255, clipped."""
    clip = lambda x, low: F.least(F.greatest(x, F.lit(low)), F.lit(1.0))
    return image.select(*PIXEL, clip(F.col("r") / 100.0, 0.0).alias("r"), *(clip(F.col(c) / 100.0, -1.0).alias(c) for c in "xyz"), clip(F.col("intensity") / 255.0, 0.0).alias("intensity"))


def seen_through(occupied: DataFrame, image: DataFrame, touched: DataFrame, th: Thresholds = THRESHOLDS) -> DataFrame:
    """Occupied cells with in_view, see_through, protected in a frame. occupied: frame, ring, ix, iy, x, y, z in the vehicle frame.

    A cell is seen through if the pixel at its centre shows a return farther than the cell by
    more than the tolerance; pixels without a return say nothing. Cells that got a return in
    the frame are protected.
    """
    dz = F.col("z") - th.sensor_height_m
    at = occupied.withColumn("cell_r", S.range_m(F.col("x"), F.col("y"), dz)).withColumns({"v": S.elevation_bin(dz, F.col("cell_r"), th), "u": S.azimuth_bin(F.col("x"), F.col("y"), th)})
    at = at.withColumn("in_view", S.in_view(F.col("v"), F.col("cell_r"), th))
    far = at.join(image.select(*PIXEL, F.col("r").alias("image_r")), PIXEL, "left").join(touched.select("frame", *CELL, F.lit(True).alias("now")).distinct(), ["frame", *CELL], "left")
    through = F.col("in_view") & F.coalesce(F.col("image_r") > F.col("cell_r") + M.clear_tolerance(F.col("cell_r"), th), F.lit(False))
    guard = F.coalesce("now", F.lit(False))
    return far.withColumns({"see_through": through & ~guard, "protected": through & guard}).drop("now")


def miss(log_odds: Column, see_through: Column, th: Thresholds = THRESHOLDS) -> Column:
    low, high = th.log_odds_clamp
    return F.when(see_through, F.greatest(F.least(log_odds + th.log_odds_miss, F.lit(high)), F.lit(low))).otherwise(log_odds)


def cleanup_counters(tested: DataFrame) -> DataFrame:
    """Per frame: cells tested, out of view, protected, cleared."""
    return tested.groupBy("frame").agg(F.count(F.lit(1)).alias("tested"), F.count_if(~F.col("in_view")).alias("out_of_view"), F.count_if("protected").alias("protected"), F.count_if("see_through").alias("cleared"))


def occupied_in_frame(state: DataFrame, ego_x: Column, ego_y: Column, s: Schedule = C.FOVEATED) -> DataFrame:
    """Occupied cells of a state with frame, as seen_through() takes them."""
    there = state.where(M.occupancy(F.col("obs_count"), F.col("log_odds"), F.col("flags")) == C.OCCUPIED)
    z = F.when(F.col("ceiling_cm") != C.NO_CEILING, F.col("ceiling_cm")).otherwise(F.col("ground_cm")) / 100.0
    at = F.struct((L.centre(F.col("ix"), F.col("ring"), s) - ego_x).alias("x"), (L.centre(F.col("iy"), F.col("ring"), s) - ego_y).alias("y"), z.alias("z"))
    return there.select("frame", *CELL, F.inline(F.array(at)))  # by a generator, so that what follows works on three numbers rather than on copies of their formulas


def carried(points: DataFrame, relative: DataFrame) -> DataFrame:
    """The returns of each frame as the sensor would have them in the next one: frame + 1, x, y, z moved by that frame's transform.

    relative: frame, t (12 numbers, row-major 3 x 4): from the sensor one frame before to the
    sensor now. Frames without a transform, as the one after the last, have no successor.
    """
    t, xyz = [F.col("t")[n] for n in range(12)], [F.col(c) for c in "xyz"]
    row = lambda r: t[4 * r] * xyz[0] + t[4 * r + 1] * xyz[1] + t[4 * r + 2] * xyz[2] + t[4 * r + 3]
    ahead = points.withColumn("frame", F.col("frame") + 1).join(relative.select("frame", "t"), "frame")
    return ahead.withColumns({c: row(r) for r, c in enumerate("xyz")}).drop("t")


def _compared(now: DataFrame, before: DataFrame, on: list[str], threshold_m: float, min_range_m: float) -> DataFrame:
    both = now.join(before.withColumnRenamed("r", "r_before"), on).where(F.col("r") >= min_range_m)
    return both.withColumn("residual", F.abs(F.col("r") - F.col("r_before"))).withColumn("moved", F.col("residual") > threshold_m)


def residual_motion(points: DataFrame, relative: DataFrame, th: Thresholds = THRESHOLDS, threshold_m: float = 0.75, min_range_m: float = 2.0) -> DataFrame:
    """frame, v, u, r, r_before, residual, moved: pixels that a frame's image shares with the one before it, reprojected to where the sensor is now.

    The image before is projected anew after the move, the closest return of a pixel winning,
    so that what the sensor's own motion explains leaves no residual. relative: as in
    carried(). Pixels closer than min_range_m, and those that one of both images lacks, have
    no row; neither has a first frame. One pass over the points and one equi-join by pixel.
    """
    closest = lambda p: with_pixels(p, th).where("r > 1e-6").groupBy(*PIXEL).agg(F.min("r").alias("r"))
    return _compared(closest(points), closest(carried(points, relative)), PIXEL, threshold_m, min_range_m)


def moving_returns(points: DataFrame, motion: DataFrame, th: Thresholds = THRESHOLDS, min_range_m: float = 2.0) -> DataFrame:
    """Every return with candidate: whether its own pixel moved, whichever return that pixel shows. Returns closer than min_range_m never are."""
    pixels = motion.where("moved").select(*PIXEL, F.lit(True).alias("hit"))
    at = with_pixels(points, th).join(pixels, PIXEL, "left")
    return at.withColumn("candidate", F.coalesce("hit", F.lit(False)) & (F.col("r") >= min_range_m)).drop("hit", "v_raw", "v", "u", "r")


def residual_motion_stream(points: DataFrame, relative: DataFrame, th: Thresholds = THRESHOLDS, threshold_m: float = 0.75, min_range_m: float = 2.0, frame_s: float = THRESHOLDS.frame_s, late: str = "0 seconds") -> DataFrame:
    """residual_motion() of a stream of returns with `ts`, the time of their frame: a join of two streams.

    Each frame's image is a windowless aggregation by its time, and meets the image of the
    frame before, reprojected and so dated one frame later. The watermark of `late` closes a
    frame once a later one has come, and drops both images' state. relative: a table.
    """
    on = ["ts", *PIXEL]
    closest = lambda p: with_pixels(p, th).where("r > 1e-6").withWatermark("ts", late).groupBy(*on).agg(F.min("r").alias("r"))
    ahead = carried(points, relative).withColumn("ts", F.col("ts") + F.make_dt_interval(secs=F.lit(frame_s)))
    return _compared(closest(points), closest(ahead), on, threshold_m, min_range_m)


#: Metres by which the ranges of neighbouring pixels of one instance differ at most.
INSTANCE_GAP_M = 0.75


def _united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least one that it reaches over the edges (a, b): in each round all roots that an edge ties to a smaller one go under it."""
    label = np.arange(n)
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            return label
        np.minimum.at(label, high[apart], low[apart])
        while not np.array_equal(further := label[label], label):
            label = further


def _labelled(pixels: pd.DataFrame) -> pd.DataFrame:
    """Components of one frame's moving pixels, each named by its first pixel. Runs along the image's rows are united where a pixel of one continues in the row below, or around the azimuth."""
    width = THRESHOLDS.azimuths
    pixels = pixels.sort_values(["v", "u"])
    at, r = (pixels["v"] * width + pixels["u"]).to_numpy(np.int64), pixels["r"].to_numpy()
    row = at // width
    head = np.ones(len(at), bool)
    head[1:] = (row[1:] != row[:-1]) | (np.diff(at) > 1) | ~(np.abs(np.diff(r)) <= INSTANCE_GAP_M)
    run = np.cumsum(head) - 1
    edges = []
    for here, there in ((np.arange(len(at)), at + width), (np.flatnonzero(at % width == width - 1), at[at % width == width - 1] - width + 1)):
        other = np.minimum(np.searchsorted(at, there), len(at) - 1)
        met = (at[other] == there) & (np.abs(r[here] - r[other]) <= INSTANCE_GAP_M)
        edges.append((run[here[met]], run[other[met]]))
    first = _united(int(head.sum()), *map(np.concatenate, zip(*edges, strict=True)))
    return pixels.assign(instance=at[head][first][run])


def instances(image: DataFrame, least_pixels: int = 4) -> DataFrame:
    """frame, instance (its smallest pixel), n, centre and box of the components of moving pixels, and rank by size.

    An image has at most rings x azimuths pixels, so a frame always fits a task.
    """
    moving = image.where("moving").select("frame", "v", "u", "r", "x", "y", "z")
    label = moving.groupBy("frame").applyInPandas(_labelled, "frame int, v int, u int, r double, x double, y double, z double, instance bigint")
    found = label.groupBy("frame", "instance").agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max)))).where(F.col("n") >= least_pixels)
    from pyspark.sql import Window

    return found.withColumn("rank", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("n"), "instance")))


def blind_cone_m(th: Thresholds = THRESHOLDS) -> float:
    return th.sensor_height_m / math.tan(math.radians(-th.phi_min_deg))


def capped(occupied: DataFrame, cap: int, s: Schedule = C.FOVEATED) -> DataFrame:
    """The first `cap` occupied cells of each frame in storage order; a bound for small targets, off by default."""
    from pyspark.sql import Window

    order = Window.partitionBy("frame").orderBy(L.slot(F.col("ix"), F.col("iy"), F.col("ring"), s))
    return occupied.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= cap).drop("nth")


def truncated(points: DataFrame, th: Thresholds = THRESHOLDS) -> DataFrame:
    """The first max_points returns of a sweep whose point_id counts from 0."""
    return points.where(F.col("point_id") < th.max_points)
