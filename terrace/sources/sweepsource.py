"""Recorded sweeps as a Spark data source: `spark.read.format("sweeps")` and `spark.readStream.format("sweeps")`.

`path` is the folder above `sequences`. Each row is a return with its label. A task reads
`frames_per_partition` frames (1). Comparisons of `seq` and `frame` with constants choose the
files, so that other frames are neither opened nor planned as tasks. `labels` says what a
sweep without a label file means: label 0 (`optional`), an error (`required`), or that labels
aren't read at all (`none`). A label file must have one label for each return.

As a stream, a sequence's frames are taken as they appear, in the order of their numbers; with
`labels` required, a frame waits for its label file, and those after it wait too. Offsets are
the last frame of each sequence, so a recorder must write frames in order, and write them
elsewhere first and rename them, as Spark's own file sources ask.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

from terrace.shipping import ship_package

FORMAT = "sweeps"
SCHEMA = "seq string, frame int, point_id int, x float, y float, z float, intensity float, raw_label bigint"
LABELS = ("optional", "required", "none")
_NAME = re.compile(r"sequences/([^/]+)/(velodyne|labels)/(\d+)\.(?:bin|label)$")
_TESTS = {
    ds.EqualTo: lambda a, b: a == b,
    ds.In: lambda a, b: a in b,
    ds.GreaterThan: lambda a, b: a > b,
    ds.GreaterThanOrEqual: lambda a, b: a >= b,
    ds.LessThan: lambda a, b: a < b,
    ds.LessThanOrEqual: lambda a, b: a <= b,
}


@dataclass
class Frames(ds.InputPartition):
    """Frames that one task reads: sequence, number, sweep file, label file or None."""

    files: list[tuple[str, int, str, str | None]]


class _Folder:
    """The files below a root and what is read of them."""

    def __init__(self, options):
        if "path" not in options:
            raise ValueError("sweeps need a path: the folder above `sequences`")
        self.path = options["path"].rstrip("/")
        self.labels = options.get("labels", "optional")
        if self.labels not in LABELS:
            raise ValueError(f"labels must be one of {LABELS}, not {self.labels!r}")
        self.together = int(options.get("frames_per_partition", 1))
        if self.together < 1:
            raise ValueError("frames_per_partition must be 1 or more")

    def _store(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), self.path)

    def frames(self, wanted=lambda seq, frame: True) -> list[tuple[str, int, str, str | None]]:
        """Sequence, number, sweep file, label file of the wanted frames, in order."""
        store, root = self._store()
        sweeps, labels = {}, {}
        for sequence in store.get_file_info(pyarrow.fs.FileSelector(f"{root}/sequences")):
            for folder, found in (("velodyne", sweeps), ("labels", labels)):
                for file in store.get_file_info(pyarrow.fs.FileSelector(f"{sequence.path}/{folder}", allow_not_found=True)):
                    if (m := _NAME.search(file.path)) and wanted(m[1], int(m[3])):
                        found[m[1], int(m[3])] = file.path
        return [(*key, sweeps[key], None if self.labels == "none" else labels.get(key)) for key in sorted(sweeps)]

    def split(self, files: list[tuple[str, int, str, str | None]]) -> list[Frames]:
        return [Frames(files[n : n + self.together]) for n in range(0, len(files), self.together)]

    def read(self, partition: Frames | None) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        for seq, frame, sweep, label in partition.files if partition else ():  # Spark asks for one partition, None, where there are none
            with store.open_input_file(sweep) as f:
                content = f.read()
            if len(content) % 16:
                raise ValueError(f"{sweep}: {len(content)} bytes are not whole returns of 16")
            xyzi = np.frombuffer(content, "<f4").reshape(-1, 4)
            n = len(xyzi)
            raw = np.zeros(n, np.int64)
            if label is not None:
                with store.open_input_file(label) as f:
                    words = f.read()
                if len(words) != 4 * n:
                    raise ValueError(f"{label}: {len(words) // 4} labels for {n} returns")
                raw = np.frombuffer(words, "<u4").astype(np.int64)
            elif self.labels == "required":
                raise ValueError(f"{sweep} has no label file")
            place = [pa.array([seq]).take(pa.array(np.zeros(n, np.int32))), pa.array(np.full(n, frame, np.int32)), pa.array(np.arange(n, dtype=np.int32))]
            numbers = [pa.array(np.ascontiguousarray(xyzi[:, c])) for c in range(4)]
            yield pa.RecordBatch.from_arrays([*place, *numbers, pa.array(raw)], [c.split()[0] for c in SCHEMA.split(", ")])


class SweepReader(ds.DataSourceReader):
    def __init__(self, options):
        self.folder, self.chosen = _Folder(options), []

    def pushFilters(self, filters):  # noqa: N802
        """Takes comparisons of seq and frame, which choose files; gives back all others."""
        for f in filters:
            named = getattr(f, "attribute", None)
            if named in (("seq",), ("frame",)) and isinstance(f, ds.IsNotNull):
                continue  # neither is ever null
            if named in (("seq",), ("frame",)) and type(f) in _TESTS:
                self.chosen.append((named[0] == "seq", type(f), f.value))
            else:
                yield f

    def _wanted(self, seq: str, frame: int) -> bool:
        return all(_TESTS[test](seq if of_seq else frame, value) for of_seq, test, value in self.chosen)

    def partitions(self):
        return self.folder.split(self.folder.frames(self._wanted))

    def read(self, partition):
        return self.folder.read(partition)


class SweepStream(ds.DataSourceStreamReader):
    def __init__(self, options):
        self.folder = _Folder(options)

    def initialOffset(self):  # noqa: N802
        return {}

    def latestOffset(self):  # noqa: N802
        """The last frame of each sequence up to which all can be read."""
        last, waiting = {}, set()
        for seq, frame, _, label in self.folder.frames():
            if self.folder.labels == "required" and label is None:
                waiting.add(seq)
            if seq not in waiting:
                last[seq] = frame
        return last

    def partitions(self, start, end):
        return self.folder.split(self.folder.frames(lambda seq, frame: start.get(seq, -1) < frame <= end.get(seq, -1)))

    def read(self, partition):
        return self.folder.read(partition)


class SweepSource(ds.DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return SweepReader(self.options)

    def streamReader(self, schema):  # noqa: N802
        return SweepStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach it."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SweepSource)
