"""Readers and writers of recorded sequences: binary sweeps and labels, pose and calibration text."""

from __future__ import annotations

import os
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.shipping import ship_package

SWEEP = "seq string, frame int, point_id int, x float, y float, z float, intensity float"
LABEL = "seq string, frame int, point_id int, raw_label bigint"
_PATH = r"sequences/([^/]+)/[^/]+/(\d+)\.[a-z]+$"
#: Sensor to vehicle: up by the sensor's height. Camera axes to vehicle axes: z forward, -x left, -y up.
SENSOR_HEIGHT_M = 1.73
CAMERA_TO_VEHICLE = ((0.0, 0.0, 1.0), (-1.0, 0.0, 0.0), (0.0, -1.0, 0.0))


def _files(spark: SparkSession, root: str, folder: str, ending: str) -> DataFrame:
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ending}").load(f"{root}/sequences/*/{folder}")
    return files.select(F.regexp_extract("path", _PATH, 1).alias("seq"), F.regexp_extract("path", _PATH, 2).cast("int").alias("frame"), "content", "length")


def frames(spark: SparkSession, root: str) -> DataFrame:
    """seq, frame, bytes of every sweep on disk."""
    return _files(spark, root, "velodyne", "bin").select("seq", "frame", F.col("length").alias("bytes"))


def completeness(spark: SparkSession, root: str) -> DataFrame:
    """seq, sweeps, bytes, labels, complete: whether every sweep has a label file."""
    have = frames(spark, root).join(_files(spark, root, "labels", "label").select("seq", "frame", F.lit(1).alias("labelled")), ["seq", "frame"], "left")
    out = have.groupBy("seq").agg(F.count(F.lit(1)).alias("sweeps"), F.sum("bytes").alias("bytes"), F.count("labelled").alias("labels"))
    return out.withColumn("complete", F.col("sweeps") == F.col("labels"))


def _sweep_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            xyzi = np.frombuffer(row.content, "<f4").reshape(-1, 4)
            yield pd.DataFrame({"seq": row.seq, "frame": row.frame, "point_id": np.arange(len(xyzi), dtype=np.int32), "x": xyzi[:, 0], "y": xyzi[:, 1], "z": xyzi[:, 2], "intensity": xyzi[:, 3]})


def _label_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            words = np.frombuffer(row.content, "<u4").astype(np.int64)
            yield pd.DataFrame({"seq": row.seq, "frame": row.frame, "point_id": np.arange(len(words), dtype=np.int32), "raw_label": words})


def sweeps(spark: SparkSession, root: str, start_frame: int = 0, max_frames: int | None = None) -> DataFrame:
    """All returns of all sweeps from start_frame on, at most max_frames a sequence, with labels (0 where there is no label file)."""
    files = _files(spark, root, "velodyne", "bin").where(F.col("frame") >= start_frame)
    marks = _files(spark, root, "labels", "label").where(F.col("frame") >= start_frame)
    if max_frames is not None:
        from pyspark.sql import Window

        kept = files.select("seq", "frame").withColumn("nth", F.row_number().over(Window.partitionBy("seq").orderBy("frame"))).where(F.col("nth") <= max_frames).select("seq", "frame")
        files, marks = files.join(kept, ["seq", "frame"]), marks.join(kept, ["seq", "frame"])
    points = files.select("seq", "frame", "content").mapInPandas(_sweep_rows, SWEEP)
    labels = marks.select("seq", "frame", "content").mapInPandas(_label_rows, LABEL)
    return points.join(labels, ["seq", "frame", "point_id"], "left").withColumn("raw_label", F.coalesce("raw_label", F.lit(0)))


def poses(spark: SparkSession, path: str) -> DataFrame:
    """frame (line number), t (12 numbers, row-major 3 x 4) of a pose text file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("frame", "line"))
    return lines.select("frame", F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.try_cast("double")).alias("t")).where(F.size("t") == 12)


#: Sequences whose poses come from mapping (sequences/<seq>/poses.txt) rather than from the ground-truth files (poses/<seq>.txt), and the variable that forces one for all.
SLAM_SEQUENCES, SOURCES, FORCED = ("00", "08"), ("gt", "slam"), "TERRACE_POSES"


def pose_source(seq: str) -> str:
    """gt or slam: what the environment forces, else the sequence's own."""
    forced = os.environ.get(FORCED)
    if forced and forced not in SOURCES:
        raise ValueError(f"{FORCED} must be one of {SOURCES}, not {forced!r}")
    return forced or ("slam" if seq in SLAM_SEQUENCES else "gt")


def sequence_poses(spark: SparkSession, root: str, seq: str, source: str | None = None) -> DataFrame:
    """The poses of a sequence from its source. Where that is slam by default and there is no such file, the ground truth stands in, with a warning."""
    chosen = source or pose_source(seq)
    paths = {"gt": f"{root}/poses/{seq}.txt", "slam": f"{root}/sequences/{seq}/poses.txt"}
    if chosen == "slam" and source is None and not _exists(spark, paths["slam"]):
        warnings.warn(f"sequence {seq} has no {paths['slam']}; its ground-truth poses are used", RuntimeWarning, stacklevel=2)
        chosen = "gt"
    return poses(spark, paths[chosen])


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def scans(spark: SparkSession, root: str, seq: str, **which) -> tuple[DataFrame, DataFrame]:
    """What the live map takes of a recorded sequence: points (frame, point_id, x, y, z as the sensor sees them, xw, yw, zw, intensity, raw_label, cls, ground, moving) and transforms (frame, t)."""
    from terrace.functions.measure import is_ground, is_moving, learning_id

    transforms = vehicle_to_world(sequence_poses(spark, root, seq), calibration(spark, f"{root}/sequences/{seq}/calib.txt"))
    at = to_world(sweeps(spark, root, **which).where(F.col("seq") == seq), transforms)
    raw = F.col("raw_label").cast("int")
    labelled = at.select("frame", F.col("point_id").cast("bigint").alias("point_id"), *(F.col(c).cast("double").alias(c) for c in "xyz"), "xw", "yw", "zw", F.col("intensity").cast("double").alias("intensity"), raw.bitwiseAND(0xFFFF).alias("raw_label"))
    labelled = labelled.withColumn("cls", learning_id(F.col("raw_label"), 31))
    return labelled.withColumns({"ground": is_ground(F.col("cls")), "moving": is_moving(F.col("raw_label"))}), transforms


def calibration(spark: SparkSession, path: str) -> list[float]:
    """The 12 numbers of the `Tr:` line, or the identity without one."""
    row = spark.read.text(path).where(F.col("value").startswith("Tr:")).first()
    return [float(x) for x in row.value[3:].split()] if row else [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0]


def _product(a, b):
    """Product of two rigid transforms as columns or numbers, row-major 3 x 4."""
    out = []
    for r in range(3):
        for c in range(4):
            total = a[4 * r] * b[c] + a[4 * r + 1] * b[4 + c] + a[4 * r + 2] * b[8 + c]
            out.append(total + a[4 * r + 3] if c == 3 else total)
    return out


def vehicle_to_world(pose_table: DataFrame, tr: list[float]) -> DataFrame:
    """frame, t: vehicle to world, z up, from camera poses and the sensor-to-camera calibration."""
    flip = [x for row in CAMERA_TO_VEHICLE for x in (*row, 0.0)]
    sensor_from_vehicle = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, -SENSOR_HEIGHT_M]
    t = [F.col("t")[n] for n in range(12)]
    whole = _product(_product([F.lit(x) for x in flip], t), [F.lit(float(x)) for x in _product(tr, sensor_from_vehicle)])
    return pose_table.select("frame", F.array(*whole).alias("t"))


def to_world(points: DataFrame, transforms: DataFrame) -> DataFrame:
    """Adds the vehicle z (xv, yv, zv) and world coordinates (xw, yw, zw) of sensor-frame returns."""
    p = points.withColumns({"xv": F.col("x").cast("double"), "yv": F.col("y").cast("double"), "zv": F.col("z") + SENSOR_HEIGHT_M}).join(transforms, "frame")
    row = lambda r: F.col("t")[4 * r] * F.col("xv") + F.col("t")[4 * r + 1] * F.col("yv") + F.col("t")[4 * r + 2] * F.col("zv") + F.col("t")[4 * r + 3]
    return p.withColumns({"xw": row(0), "yw": row(1), "zw": row(2)}).drop("t")


def inverse(t: list) -> list:
    """Inverse of a rigid transform: the rotation transposed, the translation turned back."""
    turned = [t[4 * c + r] for r in range(3) for c in range(3)]
    out = []
    for r in range(3):
        row = turned[3 * r : 3 * r + 3]
        out += [*row, -(row[0] * t[3] + row[1] * t[7] + row[2] * t[11])]
    return out


def relative_transforms(transforms: DataFrame) -> DataFrame:
    """frame, t: from the vehicle one frame before to the vehicle now."""
    before = transforms.select((F.col("frame") + 1).alias("frame"), F.col("t").alias("p"))
    now, then = ([F.col(c)[n] for n in range(12)] for c in ("t", "p"))
    return transforms.join(before, "frame").select("frame", F.array(*_product(inverse(now), then)).alias("t"))


def sensor_to_world(transforms: DataFrame, height_m: float = SENSOR_HEIGHT_M) -> DataFrame:
    """frame, t: sensor to world, from vehicle to world; the sensor stands above the vehicle's origin with the same axes."""
    up = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, height_m]
    return transforms.select("frame", F.array(*_product([F.col("t")[n] for n in range(12)], [F.lit(float(x)) for x in up])).alias("t"))


def final_position(transforms: DataFrame) -> DataFrame:
    """frame, x, y of the last pose."""
    return transforms.agg(F.max_by(F.struct("frame", F.col("t")[3].alias("x"), F.col("t")[7].alias("y")), "frame").alias("p")).select("p.*")


def speeds(transforms: DataFrame, frame_s: float = 0.1) -> DataFrame:
    """frame, speed_ms from the step since the frame before; 0 for the first."""
    at = transforms.select("frame", F.col("t")[3].alias("x"), F.col("t")[7].alias("y"))
    before = at.select((F.col("frame") + 1).alias("frame"), F.col("x").alias("px"), F.col("y").alias("py"))
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    return at.join(before, "frame", "left").select("frame", F.coalesce(F.sqrt(dx * dx + dy * dy) / frame_s, F.lit(0.0)).alias("speed_ms"))


def check_upright(points: DataFrame, frame: int, tolerance_m: float = 2.0) -> None:
    """Raises unless the median world height of a frame's ground returns is near 0, as it is with z up."""
    median = points.where((F.col("frame") == frame) & F.col("ground")).agg(F.percentile("zw", F.lit(0.5))).first()[0]
    if median is not None and abs(median) > tolerance_m:
        raise ValueError(f"frame {frame}: ground stands at {median:.1f} m; are poses in another frame?")


def write_sequence(root: str, seq: str, clouds: list[tuple[np.ndarray, np.ndarray]], pose_rows: list[list[float]]) -> None:
    """Writes a small recorded-style sequence; for fixtures."""
    from pathlib import Path

    base = Path(root) / "sequences" / seq
    for folder in ("velodyne", "labels"):
        (base / folder).mkdir(parents=True, exist_ok=True)
    (Path(root) / "poses").mkdir(exist_ok=True)
    for n, (xyzi, labels) in enumerate(clouds):
        xyzi.astype("<f4").tofile(base / "velodyne" / f"{n:06d}.bin")
        labels.astype("<u4").tofile(base / "labels" / f"{n:06d}.label")
    (Path(root) / "poses" / f"{seq}.txt").write_text("".join(" ".join(map(repr, row)) + "\n" for row in pose_rows))
    (base / "calib.txt").write_text("Tr: 0 -1 0 0 0 0 -1 0 1 0 0 0\n")
