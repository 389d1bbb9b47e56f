"""Inputs that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators.fold import fold_frames
from terrace.operators.live import Pose
from terrace.operators.scatter import frame_cells
from terrace.operators.stencil import traversability
from terrace.plans.sql import DRIVE, num
from terrace.sources import kitti
from terrace.sources.tables import read, sweep_points


def static_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_cells(sweep_points(spark, sf_dir).where(~F.col("moving")))


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded state of all frames of static returns."""
    return fold_frames(static_frames(spark, sf_dir))


def driven_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of a vehicle that drives 2 m ahead and 0.6 m up a frame, with world heights."""
    from terrace.sources.tables import wide_points

    z = F.element_at(F.array(*(F.lit(z) for _, _, z in DRIVE)), F.col("frame") + 1)
    return wide_points(spark, sf_dir).withColumn("zw", F.col("z") + z)


def drive() -> list[Pose]:
    return [Pose(k, x, 0.0, z) for k, x, z in DRIVE]


def _curve() -> list[tuple[int, list[float]]]:
    """frame, t (vehicle to world, row-major 3 x 4) of seven poses on a curve."""
    c, s, x, y, out = 1.0, 0.0, 0.0, 0.0, []
    for k in range(7):
        out.append((k, [c, -s, 0.0, x, s, c, 0.0, y, 0.0, 0.0, 1.0, 0.03 * k]))
        c, s, x, y = (c * 39999 - s * 400) / 40001, (s * 39999 + c * 400) / 40001, x + 0.5 * c, y + 0.5 * s
    return out


CURVE = _curve()


def _steps_sql() -> str:
    """The transform from each pose's sensor to the next one's, in numbers."""
    up = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, kitti.SENSOR_HEIGHT_M]
    sensor = [kitti._product(t, up) for _, t in CURVE]
    steps = [kitti._product(kitti.inverse(now), then) for then, now in zip(sensor, sensor[1:], strict=False)]
    return ", ".join(f"({k}, [{', '.join(map(num, t))}])" for k, t in enumerate(steps, 1))


CURVE_SQL = _steps_sql()


def patchy_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range images of moving pixels in patches: frame, v, u, r, x, y, z, moving."""
    line = read(spark, sf_dir, "lineitem")
    v, u = (F.col("l_orderkey") * 7 + F.col("l_partkey")) % 64, (F.col("l_partkey") * 31 + F.col("l_suppkey") * 7 + F.col("l_orderkey")) % 512
    at = line.select((F.col("l_linenumber") - 1).cast("int").alias("frame"), v.cast("int").alias("v"), u.cast("int").alias("u"), (10 + (F.col("l_quantity").cast("int") % 5) * 0.25).alias("r"))
    image = at.groupBy("frame", "v", "u").agg(F.min("r").alias("r"))
    return image.select("*", F.col("r").alias("x"), F.col("u").cast("double").alias("y"), F.col("v").cast("double").alias("z"), F.lit(True).alias("moving"))


#: Cells along a patch of the raster, patches along its row and in all: they fill ring 1's window, and orders are dealt over all of them.
PATCH, PATCHES_ACROSS, PATCHES = 64, 7, 49


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of 64 x 64 cells that fill ring 1's window as far as there are rows: each with a kerb, a pothole, a bank, and noise from the data."""
    line = read(spark, sf_dir, "lineitem")
    key = (F.col("l_orderkey") * 7 + F.col("l_partkey") * 13 + F.col("l_linenumber") * 31 + F.col("l_suppkey")).cast("bigint")
    patch = F.pmod(F.floor(key / PATCH**2), F.lit(PATCHES)).alias("patch")
    at = line.select((key % PATCH).alias("i"), (F.floor(key / PATCH) % PATCH).alias("j"), patch, F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price"))
    i, j, n, across = F.col("i"), F.col("j"), F.col("n"), F.col("patch") % PATCHES_ACROSS
    cells = at.groupBy("patch", "i", "j").agg(F.max(F.col("price") % 3).alias("noise"), F.max(F.col("price") % 11).alias("top"), F.count(F.lit(1)).alias("n"))
    hole = (i - 20) * (i - 20) + (j - 42) * (j - 42) <= 5
    ground = F.col("noise") + F.when(i >= 40, 12).otherwise(0) - F.when(hole, 40).otherwise(0) + F.when(j < 8, (8 - j) * 20).otherwise(0)
    cls = F.when((i + j) % 13 == 0, 14).otherwise(8) * 8 + F.least(n, F.lit(7))
    origin = PATCH * PATCHES_ACROSS // 2
    return cells.select(
        F.lit(1).alias("ring"), (i + PATCH * across - origin).alias("ix"), (j + PATCH * F.floor(F.col("patch") / PATCHES_ACROSS) - origin).alias("iy"), ground.cast("int").alias("ground_cm"), F.when((F.col("top") == 10) & (i % 8 == 0), 150).otherwise(32767).alias("ceiling_cm"),
        F.least(n * 3 + 150, F.lit(255)).cast("int").alias("var_code"), (n % 5).cast("int").alias("log_odds"), cls.cast("int").alias("class_byte"), F.lit(0).alias("reflectivity"),
        F.least(n, F.lit(255)).cast("int").alias("obs_count"), F.lit(0).alias("frames_since_seen"), F.lit(0).alias("flags"), F.lit(6).alias("last_frame"),
    )


def raster_trav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversability(raster(spark, sf_dir))


#: Cells along a planning window.
SPAN = 44


def cost_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cost maps of 44 x 44 cells for each 1936 parts: window, map_id, i, j, trav, unknown, cost."""
    from terrace.functions.measure import cost_from_bits

    part = read(spark, sf_dir, "part")
    number = F.col("p_partkey")
    base = part.select(F.floor(number / SPAN**2).alias("window"), F.pmod(number, F.lit(SPAN**2)).cast("int").alias("cell"), F.col("p_size").cast("int").alias("size"))
    lattice = base.select("window").distinct().withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(SPAN**2 - 1)))).join(base, ["window", "cell"], "left")
    size = F.coalesce("size", F.lit(0))
    fine = F.when(size % 10 == 9, 4).otherwise(0) + F.when(size % 7 == 3, 8).otherwise(0) + F.when(size % 5 == 1, 16).otherwise(0)
    coarse = F.when(size % 10 == 8, 4).otherwise(0) + F.when(size % 4 == 3, 8).otherwise(0) + F.when(size % 9 == 1, 32).otherwise(0)
    maps = lattice.withColumn("m", F.explode(F.array(F.struct(F.lit("fine").alias("map_id"), fine.alias("trav")), F.struct(F.lit("coarse").alias("map_id"), coarse.alias("trav")))))
    out = maps.select("window", "m.map_id", F.floor(F.col("cell") / SPAN).alias("i"), (F.col("cell") % SPAN).cast("bigint").alias("j"), F.col("m.trav").cast("int").alias("trav"), (size == 0).alias("unknown"))
    return out.withColumn("cost", cost_from_bits(F.col("trav"), F.col("unknown")))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / SPAN**2).alias("window")).distinct()


def plan_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """window, query_id, si, sj, gi, gj: eight crossings of every planning window."""
    q = F.col("query_id")
    asked = windows(spark, sf_dir).withColumn("query_id", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return asked.select("window", "query_id", (1 + q).alias("si"), F.lit(2).alias("sj"), (42 - q).alias("gi"), F.lit(41).alias("gj"))


COST_SQL = """cm AS (SELECT win AS "window", map_id, i, j, trav, size = 0 AS unknown, CASE WHEN trav & 7 <> 0 THEN 'inf'::DOUBLE ELSE 1e0 + CASE WHEN trav & 8 <> 0 THEN 2e0 ELSE 0e0 END
    + CASE WHEN trav & 16 <> 0 THEN 3e0 ELSE 0e0 END + CASE WHEN size = 0 OR trav & 32 <> 0 THEN 4e0 ELSE 0e0 END END AS cost
  FROM (SELECT win, map_id, i, j, size, (CASE WHEN map_id = 'fine' THEN (CASE WHEN size % 10 = 9 THEN 4 ELSE 0 END) + (CASE WHEN size % 7 = 3 THEN 8 ELSE 0 END) + (CASE WHEN size % 5 = 1 THEN 16 ELSE 0 END)
      ELSE (CASE WHEN size % 10 = 8 THEN 4 ELSE 0 END) + (CASE WHEN size % 4 = 3 THEN 8 ELSE 0 END) + (CASE WHEN size % 9 = 1 THEN 32 ELSE 0 END) END)::INT AS trav
    FROM (SELECT w.win, r.range // 44 AS i, r.range % 44 AS j, coalesce(p_size, 0)::INT AS size FROM (SELECT DISTINCT p_partkey // 1936 AS win FROM part) w CROSS JOIN range(1936) r
      LEFT JOIN part ON p_partkey = w.win * 1936 + r.range), (VALUES ('fine'), ('coarse')) v(map_id)))"""
