"""Sweep-shaped inputs derived from the supplied order tables, by integer arithmetic only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.measure import is_ground, is_moving, learning_id
from terrace.shipping import ship_package

#: Half widths in mm of the patch that returns fall into, and the x offsets in mm that put patches into each ring.
NEAR_MM, ANCHORS_MM = 1000, (0, 15_000, 35_000, 75_000)
RAW_LABELS = (40, 44, 48, 49, 70, 72, 50, 80, 10, 252)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def with_labels(points: DataFrame) -> DataFrame:
    labelled = points.withColumn("cls", learning_id(F.col("raw_label"), 31))
    return labelled.withColumns({"ground": is_ground(F.col("cls")), "moving": is_moving(F.col("raw_label"))})


def sweep_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of a standing vehicle over seven frames: frame, point_id, x, y, z (metres, vehicle and world alike), intensity, raw_label, cls, ground, moving.

    point_id orders returns within a frame; rows that tie in it are alike in all columns used.
    """
    line = read(spark, sf_dir, "lineitem")
    c = F.col
    span = 2 * NEAR_MM
    point_id = (c("l_orderkey") * 1_000_003 + c("l_partkey")) * 1009 + c("l_suppkey") % 1009
    x_mm = (c("l_partkey") * 7919 + c("l_orderkey") * 104_729 + c("l_linenumber") * 1_299_709) % span - NEAR_MM + _pick(ANCHORS_MM, (c("l_partkey") + c("l_suppkey")) % 4)
    y_mm = (c("l_partkey") * 15_485_863 + c("l_orderkey") * 7907 + c("l_suppkey") * 32_452_843) % span - NEAR_MM
    z_mm = F.round(c("l_extendedprice") * 100).cast("bigint") % 3000 - 1700
    return with_labels(
        line.select(
            (c("l_linenumber") - 1).cast("int").alias("frame"), point_id.alias("point_id"),
            (x_mm / F.lit(1000.0)).alias("x"), (y_mm / F.lit(1000.0)).alias("y"), (z_mm / F.lit(1000.0)).alias("z"),
            (F.round(c("l_discount") * 100).cast("int") / F.lit(10.0)).alias("intensity"), _pick(RAW_LABELS, c("l_suppkey") % 10).alias("raw_label"),
        )
    )


def wide_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns spread over the whole map around a vehicle that drives 2 m a frame: x, y in its frame, xw, yw in the world."""
    line = read(spark, sf_dir, "lineitem")
    c = F.col
    xr = (c("l_partkey") * 7919 + c("l_orderkey") * 104_729 + c("l_linenumber") * 1_299_709) % 200_000 - 100_000
    yr = (c("l_partkey") * 15_485_863 + c("l_orderkey") * 7907 + c("l_suppkey") * 32_452_843) % 200_000 - 100_000
    scale = F.when(c("l_quantity") <= 25, 10_000.0).otherwise(1000.0)
    frame = (c("l_linenumber") - 1).cast("int")
    out = line.select(
        frame.alias("frame"), ((c("l_orderkey") * 1_000_003 + c("l_partkey")) * 1009 + c("l_suppkey") % 1009).alias("point_id"),
        (xr / scale).alias("x"), (yr / scale).alias("y"), ((F.round(c("l_extendedprice") * 100).cast("bigint") % 3000 - 1700) / F.lit(1000.0)).alias("z"),
        (F.round(c("l_discount") * 100).cast("int") / F.lit(10.0)).alias("intensity"), _pick(RAW_LABELS, c("l_suppkey") % 10).alias("raw_label"),
        (c("l_linenumber") * 2.5).alias("speed"),
    )
    return with_labels(out.withColumns({"xw": F.col("x") + 2.0 * F.col("frame"), "yw": F.col("y")}))


#: The same points in SQL, for the queries that state expected results.
_LABEL_SQL = "CASE raw_label WHEN 40 THEN 8 WHEN 44 THEN 9 WHEN 48 THEN 10 WHEN 49 THEN 11 WHEN 70 THEN 14 WHEN 72 THEN 16 WHEN 50 THEN 12 WHEN 80 THEN 17 WHEN 10 THEN 0 WHEN 252 THEN 0 ELSE 31 END"
_COMMON_SQL = """(l_linenumber - 1)::INT AS frame, (l_orderkey * 1000003 + l_partkey) * 1009 + l_suppkey % 1009 AS point_id,
  (round(l_extendedprice * 100)::BIGINT % 3000 - 1700) / 1e3 AS z, round(l_discount * 100)::INT / 1e1 AS intensity,
  [40,44,48,49,70,72,50,80,10,252][l_suppkey % 10 + 1] AS raw_label"""
_DERIVED_SQL = f"{_LABEL_SQL} AS cls, {_LABEL_SQL} IN (8, 9, 10, 11, 16) AS ground, raw_label BETWEEN 250 AND 259 AS moving"
PTS_SQL = f"""pts AS (SELECT *, {_DERIVED_SQL} FROM (SELECT {_COMMON_SQL},
  ((l_partkey * 7919 + l_orderkey * 104729 + l_linenumber * 1299709) % 2000 - 1000 + [0,15000,35000,75000][(l_partkey + l_suppkey) % 4 + 1]) / 1e3 AS x,
  ((l_partkey * 15485863 + l_orderkey * 7907 + l_suppkey * 32452843) % 2000 - 1000) / 1e3 AS y FROM lineitem))"""
WIDE_SQL = f"""wide AS (SELECT *, x + 2e0 * frame AS xw, y AS yw, {_DERIVED_SQL} FROM (SELECT {_COMMON_SQL}, l_linenumber * 2.5e0 AS speed,
  ((l_partkey * 7919 + l_orderkey * 104729 + l_linenumber * 1299709) % 200000 - 100000) / CASE WHEN l_quantity <= 25 THEN 1e4 ELSE 1e3 END AS x,
  ((l_partkey * 15485863 + l_orderkey * 7907 + l_suppkey * 32452843) % 200000 - 100000) / CASE WHEN l_quantity <= 25 THEN 1e4 ELSE 1e3 END AS y FROM lineitem))"""
