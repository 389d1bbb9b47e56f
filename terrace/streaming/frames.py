"""Sweeps as streams: the running map, and windowed figures of late-tolerant event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrace import config as C
from terrace.config import THRESHOLDS, Thresholds
from terrace.operators import live
from terrace.scratch import drop_written, scratch_path

POINTS = "frame int, point_id bigint, x double, y double, z double, xw double, yw double, zw double, intensity double, raw_label int, cls int, ground boolean, moving boolean, ego_x double, ego_y double, ego_z double"


def read_frames(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Points as files arrive in a folder, one file a frame, each row with the vehicle's place in the world."""
    return spark.readStream.schema(POINTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


class RunningMap:
    """A live map over a stream. Each micro-batch takes the state that the one before left in `root` and leaves the next beside it, with the last pose;
    states older than the one before go. Offsets are kept in root too, so a driver that starts again on the same root goes on where it was, and a batch
    that is repeated starts from the same state."""

    def __init__(self, spark: SparkSession, root: str | None = None, schedule: C.Schedule = C.FOVEATED, th: Thresholds = THRESHOLDS, cleanup: bool = True):
        self.spark, self.schedule, self.th, self.cleanup = spark, schedule, th, cleanup
        self.root = root or scratch_path(spark, "map")

    def _table(self, kind: str, batch: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{kind}/{batch:08d}")

    def _batches(self) -> list[int]:
        """Batches whose state and pose are there in whole."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/pose")
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = [x.getPath() for x in files.listStatus(at)] if files.exists(at) else []
        return sorted(int(p.getName()) for p in done if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def state(self) -> DataFrame:
        done = self._batches()
        return self._table("state", done[-1], live.STATE_SCHEMA) if done else live.empty(self.spark)

    def step(self, points: DataFrame, batch: int) -> None:
        """Folds a micro-batch, frame by frame, into the state after the batch before it."""
        state, datum = live.empty(self.spark), None
        if before := [n for n in self._batches() if n < batch]:
            state = self._table("state", before[-1], live.STATE_SCHEMA)
            datum = self._table("pose", before[-1], "datum double").first().datum
        poses = points.select("frame", "ego_x", "ego_y", "ego_z").distinct().orderBy("frame").collect()  # a row for each frame of the trigger
        cells = None
        for row in poses:
            pose, last = live.Pose(row.frame, row.ego_x, row.ego_y, row.ego_z), cells
            cells = live.step(state, points.where(F.col("frame") == pose.frame), pose, pose.datum if datum is None else datum, self.schedule, self.th, self.cleanup)
            state, datum = live.state_of(cells, self.th), pose.datum
            if last is not None:
                drop_written(last)
        state.write.mode("overwrite").parquet(f"{self.root}/state/{batch:08d}")
        self.spark.createDataFrame([(datum if datum is not None else 0.0,)], "datum double").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/pose/{batch:08d}")
        if cells is not None:
            drop_written(cells)
        for old in before[:-1]:
            drop_written(self._table("state", old, live.STATE_SCHEMA))
            drop_written(self._table("pose", old, "datum double"))

    def start(self, points: DataFrame) -> StreamingQuery:
        return points.writeStream.foreachBatch(self.step).option("checkpointLocation", f"{self.root}/offsets").trigger(availableNow=True).start()


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total of tumbling windows; rows later than the watermark are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
