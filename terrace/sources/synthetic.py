"""An analytic scene: a crowned road between kerbs, a ramp, a pothole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.config import THRESHOLDS
from terrace.functions.sphere import in_field_of_view

# The scene's dimensions in metres.
KERB_Y, KERB_HEIGHT, RAMP_X, RAMP_SLOPE = 3.0, 0.12, 30.0, 0.06
POTHOLE_X, POTHOLE_Y, POTHOLE_R, POTHOLE_DEPTH = 18.0, 0.0, 0.3, 0.4
ROAD, SIDEWALK, PARKING = 40, 48, 44


def terrain_height(x: Column, y: Column, seed: float = 0.0) -> Column:
    side = F.least(F.abs(y), F.lit(KERB_Y))
    dx, dy = x - POTHOLE_X, y - POTHOLE_Y
    return (
        side * side * -0.02 / KERB_Y
        + F.when(F.abs(y) > KERB_Y, KERB_HEIGHT).otherwise(0.0)
        + F.when(x > RAMP_X, RAMP_SLOPE * (x - RAMP_X)).otherwise(0.0)
        + F.when(F.abs(y) > KERB_Y + 1.0, 0.02 * F.sin(12.7 * x + seed) * F.cos(11.3 * y - seed)).otherwise(0.0)
        - F.when(F.sqrt(dx * dx + dy * dy) < POTHOLE_R, POTHOLE_DEPTH).otherwise(0.0)
    )


def class_at(y: Column) -> Column:
    return F.when(F.abs(y) <= KERB_Y, ROAD).when(F.abs(y) <= KERB_Y + 1.0, SIDEWALK).otherwise(PARKING)


def beam_range(phi: Column, theta: Column, pose_x: Column, height_m: float = THRESHOLDS.sensor_height_m, most_m: float = 100.0, seed: float = 0.0) -> Column:
    """Range at which a beam meets the terrain, by 48 bisections; null where it does not."""

    def above(r: Column) -> Column:
        return height_m + r * F.tan(phi) - terrain_height(r * F.cos(theta) + pose_x, r * F.sin(theta), seed)

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) * 0.5
        up = above(mid) > 0
        return F.struct(F.when(up, mid).otherwise(acc["lo"]).alias("lo"), F.when(up, acc["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(most_m).alias("hi"))
    r = F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, halve, lambda acc: (acc["lo"] + acc["hi"]) * 0.5)
    return F.when(above(F.lit(most_m)) <= 0, r)


def scan(spark: SparkSession, frames: int = 1, step_m: float = 2.0, beams: int = 64, azimuths: int = 720) -> DataFrame:
    """Ground returns of sweeps along x: frame, point_id, x, y, z (vehicle frame), xw, raw_label."""
    th = THRESHOLDS
    low, high = F.radians(F.lit(th.phi_min_deg + 0.001)), F.radians(F.lit(th.phi_max_deg - 0.001))
    ids = spark.range(frames * beams * azimuths).withColumns({"frame": F.floor(F.col("id") / (beams * azimuths)).cast("int"), "beam": F.floor(F.col("id") / azimuths) % beams, "step": F.col("id") % azimuths})
    rays = ids.withColumns({"phi": low + (high - low) * F.col("beam") / (beams - 1), "theta": F.radians(F.col("step") * 360.0 / azimuths - 180.0), "pose_x": F.col("frame") * step_m})
    hits = rays.where(F.col("phi") < F.radians(F.lit(-0.2))).withColumn("r", beam_range(F.col("phi"), F.col("theta"), F.col("pose_x"))).where("r IS NOT NULL AND r > 0")
    x, y = F.col("r") * F.cos("theta"), F.col("r") * F.sin("theta")
    on = hits.withColumns({"x": x, "y": y}).withColumn("xw", F.col("x") + F.col("pose_x")).withColumn("z", terrain_height(F.col("xw"), F.col("y")))
    kept = on.where(F.abs(th.sensor_height_m + F.col("r") * F.tan("phi") - F.col("z")) < 1e-6)
    return kept.select("frame", (F.col("id") % (beams * azimuths)).alias("point_id"), "x", "y", "z", "xw", class_at(F.col("y")).alias("raw_label"))


# Raw labels and dimensions (metres) of what stands and moves on the terrain; counts are returns a sweep.
BUILDING, VEGETATION, POLE, TRAFFIC_SIGN, MOVING_CAR, MOVING_PERSON = 50, 70, 80, 81, 252, 254
STANDING = (
    # label, returns, x from, to, |y| from, to, both sides, z from, to
    (BUILDING, 6000, 6.0, 45.0, 7.0, 7.0, True, 0.0, 3.0),
    (POLE, 900, 12.5, 13.5, 4.4, 4.6, False, 0.2, 2.5),
    (TRAFFIC_SIGN, 400, 12.4, 13.6, 4.2, 4.8, False, 2.2, 2.9),
    (VEGETATION, 1200, 20.0, 44.0, 5.0, 6.0, True, 1.5, 3.4),
)
CAR_RETURNS, CAR_AHEAD, CAR_GAIN = 400, 12.0, 0.5
PERSON_RETURNS, CROWD_X, CROWD_Y = 24, (4.0, 34.0), (-8.0, 8.0)


def uniform(low: float, high: float, *key: Column | str | int) -> Column:
    """A number between the bounds that follows from the key alone, so a scene does not depend on partitions."""
    h = F.xxhash64(*(F.col(k) if isinstance(k, str) else F.lit(k) if isinstance(k, int) else k for k in key))
    return low + (high - low) * F.pmod(h, F.lit(1 << 40)).cast("double") / float(1 << 40)


def _placed(rows: DataFrame, x: Column, y: Column, z: Column, label: int) -> DataFrame:
    out = rows.select("frame", "n", x.alias("x"), y.alias("y"), z.alias("z"), F.lit(label).alias("raw_label"))
    return out.where(in_field_of_view(F.col("x"), F.col("y"), F.col("z")))


def _returns(spark: SparkSession, frames: int, count: int) -> DataFrame:
    return spark.range(frames * count).select(F.floor(F.col("id") / count).cast("int").alias("frame"), (F.col("id") % count).alias("n"))


def standing(spark: SparkSession, frames: int = 1, seed: int = 0) -> DataFrame:
    """frame, n, x, y, z, raw_label: facades on both sides, a pole, a sign, a canopy, in the vehicle frame."""
    parts = []
    for label, count, x0, x1, y0, y1, both, z0, z1 in STANDING:
        at = lambda low, high, salt: uniform(low, high, "frame", "n", label * 8 + salt, seed)  # noqa: B023, E731
        side = F.when(at(0.0, 1.0, 3) < 0.5, -1.0).otherwise(1.0) if both else F.lit(1.0)
        parts.append(_placed(_returns(spark, frames, count), at(x0, x1, 0), at(y0, y1, 1) * side, at(z0, z1, 2), label))
    return reduce(DataFrame.unionByName, parts)


def people(spark: SparkSession, number: int, frames: int = 1, seed: int = 0) -> DataFrame:
    """Returns of people spread over a patch ahead, each a body of PERSON_RETURNS."""
    rows = _returns(spark, frames, number * PERSON_RETURNS).withColumn("who", F.floor(F.col("n") / PERSON_RETURNS))
    body = lambda low, high, salt: uniform(low, high, "frame", "n", salt, seed)
    place = lambda bounds, salt: uniform(*bounds, "frame", "who", salt, seed)
    return _placed(rows, place(CROWD_X, 901) + body(-0.25, 0.25, 902), place(CROWD_Y, 903) + body(-0.25, 0.25, 904), body(0.0, 1.8, 905), MOVING_PERSON)


def car(spark: SparkSession, frames: int = 1, seed: int = 0) -> DataFrame:
    """Returns of a car ahead that pulls away from the vehicle frame by frame."""
    at = lambda low, high, salt: uniform(low, high, "frame", "n", salt, seed)
    x = CAR_AHEAD + CAR_GAIN * F.col("frame") + at(-2.0, 2.0, 911)
    out = _returns(spark, frames, CAR_RETURNS).select("frame", "n", x.alias("x"), at(-1.0, 1.0, 912).alias("y"), at(0.0, 1.5, 913).alias("z"))
    return out.withColumn("raw_label", F.lit(MOVING_CAR))


def sweep(spark: SparkSession, frames: int = 1, step_m: float = 2.0, beams: int = 64, azimuths: int = 720, moving_car: bool = True, structure: bool = False, crowd: int = 0, seed: int = 0) -> DataFrame:
    """Whole sweeps: frame, point_id, x, y, z (vehicle frame), xw, raw_label, ground. The terrain's returns, then what stands and moves on it, each with ids of their own."""
    parts = [scan(spark, frames, step_m, beams, azimuths).select("frame", F.col("point_id").alias("n"), "x", "y", "z", "raw_label").withColumn("ground", F.lit(True))]
    if structure:
        parts.append(standing(spark, frames, seed).withColumn("ground", F.lit(False)))
    if crowd:
        parts.append(people(spark, crowd, frames, seed).withColumn("ground", F.lit(False)))
    if moving_car:
        parts.append(car(spark, frames, seed).withColumn("ground", F.lit(False)))
    numbered = [p.withColumn("point_id", F.xxhash64(F.lit(k), "raw_label", "n")) for k, p in enumerate(parts)]
    every = reduce(DataFrame.unionByName, numbered)
    return every.select("frame", "point_id", "x", "y", "z", (F.col("x") + F.col("frame") * step_m).alias("xw"), "raw_label", "ground")


def demo_raster(spark: SparkSession, side: int = 200, cell_m: float = 0.5) -> DataFrame:
    """i, j, height_m, cls of a small raster: a road along x, a ramp beyond it, two boxes."""
    at = spark.range(side * side).select(F.floor(F.col("id") / side).alias("i"), (F.col("id") % side).alias("j"))
    x, y = (F.col("i") + 0.5) * cell_m, (F.col("j") + 0.5 - side / 2) * cell_m
    ramp = F.when(x > side * cell_m * 0.6, 0.06 * (x - side * cell_m * 0.6)).otherwise(0.0)
    box = (x.between(20, 24) & y.between(6, 10)) | (x.between(40, 43) & y.between(-12, -8))
    return at.select("i", "j", (ramp + F.when(box, 2.0).otherwise(0.0)).alias("height_m"), F.when(box, 12).when(F.abs(y) <= 4, 8).otherwise(16).alias("cls"))
