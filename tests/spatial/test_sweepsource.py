"""Recorded sweeps as a data source: batch, pushed filters, streams, damaged files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.sources import kitti, sweepsource

IDENTITY = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0]


def clouds(sizes, seed=0):
    rng = np.random.default_rng(seed)
    return [(rng.normal(size=(n, 4)), rng.integers(0, 2**32, n)) for n in sizes]


@pytest.fixture
def root(tmp_path, spark):
    sweepsource.register(spark)
    kitti.write_sequence(str(tmp_path), "00", clouds([5, 0, 7, 9]), [IDENTITY] * 4)
    kitti.write_sequence(str(tmp_path), "01", clouds([3, 4], 1), [IDENTITY] * 2)
    return tmp_path


def sweeps(spark, root, **options):
    return spark.read.format("sweeps").options(**options).load(str(root))


def test_rows_equal_those_of_the_reader_by_joins(spark, root):
    got = sorted(map(tuple, sweeps(spark, root).collect()))
    other = kitti.sweeps(spark, str(root))
    assert len(got) == 28 and got == sorted(map(tuple, other.select("seq", "frame", "point_id", "x", "y", "z", "intensity", "raw_label").collect()))
    assert max(r[-1] for r in got) > 2**31  # labels are unsigned
    assert sweeps(spark, "file://" + str(root)).count() == 28


def test_filters_choose_files(spark, root):
    (root / "sequences/00/velodyne/000003.bin").write_bytes(b"\0" * 17)
    with pytest.raises(Exception, match="not whole returns"):
        sweeps(spark, root).count()
    found = sweeps(spark, root).where("frame < 3")  # the damaged file is not opened
    assert found.count() == 19 and found.rdd.getNumPartitions() == 5
    assert sweeps(spark, root).where("seq = '01' AND frame >= 1").rdd.getNumPartitions() == 1
    assert sweeps(spark, root).where("frame IN (0, 2) AND x > 0").where("seq <> '01'").count() == sum(
        int((c[:, 0].astype("<f4") > 0).sum()) for c, _ in (clouds([5, 0, 7, 9])[k] for k in (0, 2))
    )
    assert sweeps(spark, root, frames_per_partition=2).where("frame < 3").rdd.getNumPartitions() == 3
    assert sweeps(spark, root).where("frame > 99").count() == 0


def test_labels(spark, root):
    (root / "sequences/01/labels/000001.label").unlink()
    assert sweeps(spark, root).where("seq = '01' AND frame = 1").agg(F.sum("raw_label")).first()[0] == 0
    assert sweeps(spark, root, labels="none").agg(F.max("raw_label")).first()[0] == 0
    with pytest.raises(Exception, match="has no label file"):
        sweeps(spark, root, labels="required").count()
    (root / "sequences/00/labels/000000.label").write_bytes(b"\0" * 16)
    with pytest.raises(Exception, match="4 labels for 5 returns"):
        sweeps(spark, root).count()
    with pytest.raises(Exception, match="labels must be one of"):
        sweeps(spark, root, labels="some").count()
    with pytest.raises(Exception, match="need a path"):
        spark.read.format("sweeps").load().count()


def test_stream_takes_each_frame_once_and_waits_for_labels(spark, root, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")
    late = root / "sequences/00/labels/000002.label"
    kept = late.read_bytes()
    late.unlink()

    def drain():
        rows = spark.readStream.format("sweeps").option("labels", "required").load(str(root))
        query = rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).start(f"{out}/rows")
        query.awaitTermination(120)
        return sorted((r.seq, r.frame, r.n) for r in spark.read.parquet(f"{out}/rows").groupBy("seq", "frame").agg(F.count("*").alias("n")).collect())

    assert drain() == [("00", 0, 5), ("01", 0, 3), ("01", 1, 4)]  # frames 2 and 3 of 00 wait
    late.write_bytes(kept)
    kitti.write_sequence(str(root), "02", clouds([6]), [IDENTITY])
    whole = [("00", 0, 5), ("00", 2, 7), ("00", 3, 9), ("01", 0, 3), ("01", 1, 4), ("02", 0, 6)]
    assert drain() == whole and drain() == whole  # a restart goes on from the offsets
    assert sorted((r.seq, r.frame, r["count"]) for r in sweeps(spark, root).groupBy("seq", "frame").count().collect()) == whole
