"""Tracks of moving clusters: predicted, associated and dropped frame by frame, as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrace.config import THRESHOLDS, Thresholds

SCHEMA = "seq string, frame int, track_id int, x double, y double, vx double, vy double, class_id int, frames_since_seen int"
STATE = "tracks binary, next_id int, last int"
#: Columns of the array of a sequence's tracks, oldest first.
ID, X, Y, VX, VY, CLASS, AGE = range(7)
NO_TRACKS = np.zeros((0, 7))


def advance(tracks: np.ndarray, detections: np.ndarray, next_id: int, th: Thresholds = THRESHOLDS) -> tuple[np.ndarray, int]:
    """One frame. All tracks move on and age, and those unseen for too long go. Detections (x, y, class) come in turn: one within the gate of a track
    moves the nearest, which may be met again; another starts a track, in place of the one unseen longest where all places are taken."""
    now = tracks.copy()
    now[:, [X, Y]] += now[:, [VX, VY]] * th.frame_s
    now[:, AGE] += 1
    now = now[now[:, AGE] <= th.track_ttl_frames]
    for x, y, cls in detections:
        apart = np.hypot(now[:, X] - x, now[:, Y] - y)
        if len(now) and apart.min() <= th.track_gate_m:
            hit = now[apart.argmin()]
            hit[[VX, VY]] = (x - hit[X]) / th.frame_s, (y - hit[Y]) / th.frame_s
            hit[[X, Y, AGE]] = x, y, 0
        else:
            kept = np.delete(now, now[:, AGE].argmax(), axis=0) if len(now) >= th.track_capacity else now
            now = np.vstack([kept, [next_id, x, y, 0.0, 0.0, cls, 0]])
            next_id += 1
    return now, next_id


def _rows(seq: str, frame: int, tracks: np.ndarray) -> pd.DataFrame:
    whole = {"track_id": ID, "class_id": CLASS, "frames_since_seen": AGE}
    columns = {"seq": seq, "frame": frame} | {n: tracks[:, k] for n, k in (("x", X), ("y", Y), ("vx", VX), ("vy", VY))} | {n: tracks[:, k].astype(int) for n, k in whole.items()}
    return pd.DataFrame(columns, index=range(len(tracks)))[_COLUMNS]


_COLUMNS = ["seq", "frame", "track_id", "x", "y", "vx", "vy", "class_id", "frames_since_seen"]


def _found(frames: pd.DataFrame) -> dict[int, np.ndarray]:
    """Detections of each frame, in order."""
    return {int(f): g[["x", "y", "class_id"]].to_numpy(float) for f, g in frames.sort_values(["frame", "det"]).groupby("frame")}


_NONE = np.zeros((0, 3))


def _over(tracks: np.ndarray, next_id: int, after: int | None, found: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, int]]:
    """frame, tracks, next_id of every frame up to the last one found, those without detections too; from the first one found where none came before."""
    for frame in range(min(found) if after is None else after + 1, max(found) + 1):
        if not len(tracks) and frame not in found:
            continue
        tracks, next_id = advance(tracks, found.get(frame, _NONE), next_id)
        yield frame, tracks, next_id


def _sequence(key: tuple, frames: pd.DataFrame) -> pd.DataFrame:
    out = [_rows(key[0], frame, tracks) for frame, tracks, _ in _over(NO_TRACKS, 1, None, _found(frames))]
    return pd.concat(out) if out else _rows(key[0], 0, NO_TRACKS)


def track(detections: DataFrame) -> DataFrame:
    """Tracks alive after each frame of each sequence, frames without detections included. detections: seq, frame, det (their order), x, y, class_id.

    A sequence's detections, some tens a frame, are one group; sequences run in parallel.
    """
    return detections.select("seq", "frame", "det", "x", "y", "class_id").groupBy("seq").applyInPandas(_sequence, SCHEMA)


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One trigger of one sequence. Frames older than the last one are late and dropped."""
    stored, next_id, last = state.get if state.exists else (b"", 1, None)
    tracks = np.frombuffer(bytes(stored)).reshape(-1, NO_TRACKS.shape[1])
    found = {f: d for f, d in _found(pd.concat(list(batches))).items() if last is None or f > last}
    for frame, tracks, next_id in _over(tracks, next_id, last, found) if found else ():
        yield _rows(key[0], frame, tracks)
    state.update((tracks.tobytes(), next_id, max([*found, *([] if last is None else [last])])))


def track_stream(detections: DataFrame) -> DataFrame:
    """The same over a stream, row for row: tracks and the last frame live in keyed state; frames arrive in order, and tracks move on and age through frames without detections."""
    return detections.select("seq", "frame", "det", "x", "y", "class_id").groupBy("seq").applyInPandasWithState(_update, SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)
