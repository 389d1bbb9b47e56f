"""Count-min sketches in the shared scratch folder: counted by tasks, merged part by part, read by every task.

A sketch holds one or two rows of cells of one byte, which stop at 255. A key adds to one cell
of each row; its least cell is never below its count, or is 255. The size follows the bytes of
text to be counted up to a stated bound, so what a task reads of it is bounded; beyond the
bound the estimates grow, and whoever reads them only discards less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import load, save
from .common import scratch_path, shuffle_partitions, text_of

FULL = 255
#: Bits of a cell's number within a part, the row that a task sends; most files that a sketch is saved in; least bits of a cell's number.
PART_BITS, FILES, LEAST_BITS = 12, 128, 12
#: Parts are mostly zeros; packed, a task sends about what it counted, however many cells there are.
_CODEC = "zstd"


def cell_bits(docs: DataFrame, bytes_a_cell: int, most_bits: int) -> int:
    """Bits of a cell's number in a sketch of one cell in each row for so many bytes of text, between LEAST_BITS and most_bits."""
    size = docs.agg(F.sum(F.octet_length(text_of()).cast("bigint"))).first()[0] or 0
    return min(most_bits, max(LEAST_BITS, (size // bytes_a_cell).bit_length()))


def cells_of(hashes: np.ndarray, bits: int, depth: int) -> list[np.ndarray]:
    """The cell of each key in each row; keys are 64-bit hashes."""
    mask = np.uint64((1 << bits) - 1)
    return [((hashes >> np.uint64(32 * d)) & mask).astype(np.int64) for d in range(depth)]


def _added(cells: np.ndarray, at: np.ndarray, counts: np.ndarray) -> None:
    order = np.argsort(at)
    at, counts = at[order], counts[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    sums = np.add.reduceat(counts, first)
    cells[at[first]] = np.minimum(cells[at[first]] + sums, FULL)


def _counting(keys: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], bits: int, depth: int):
    def run(batches):
        cells = None
        for batch in batches:
            for hashes, counts in keys(batch):
                if len(hashes):
                    cells = np.zeros((depth, 1 << bits), np.uint8) if cells is None else cells
                    for row, at in zip(cells, cells_of(hashes, bits, depth), strict=True):
                        _added(row, at, counts)
        if cells is not None:
            parts = cells.reshape(depth, -1, 1 << PART_BITS).swapaxes(0, 1)
            some = np.flatnonzero(parts.any(axis=(1, 2)))
            for k in range(0, len(some), 256):
                at = some[k : k + 256]
                files = at // _parts_of(bits)
                yield pa.RecordBatch.from_pydict({"file": pa.array(files, pa.int32()), "part": pa.array(at, pa.int32()), "cells": pa.array([pa.compress(parts[x].tobytes(), _CODEC, asbytes=True) for x in at], pa.binary())})

    return run


def _parts_of(bits: int) -> int:
    """Parts in a file."""
    return max(1, (1 << bits - PART_BITS) // FILES)


def _merging(folder: str, bits: int, depth: int):
    """Sums the parts of each file, which come one after the other, and saves it."""
    parts = _parts_of(bits)

    def run(batches):
        file, total = None, None

        def done():
            save(folder, str(file), [total.reshape(-1)])
            return pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int32())})

        for batch in batches:
            for f, at, cells in zip(batch.column("file").to_pylist(), batch.column("part").to_pylist(), batch.column("cells"), strict=True):
                if f != file:
                    if file is not None:
                        yield done()
                    file, total = f, np.zeros((depth, parts, 1 << PART_BITS), np.uint8)
                own = total[:, at - f * parts]
                own[:] = np.minimum(own.astype(np.uint16) + np.frombuffer(pa.decompress(cells.as_buffer(), depth << PART_BITS, _CODEC), np.uint8).reshape(depth, -1), FULL)
        if file is not None:
            yield done()

    return run


class Sketch:
    """Where a merged sketch stands; estimates are made in tasks."""

    def __init__(self, folder: str, bits: int, depth: int):
        self.folder, self.bits, self.depth = folder, bits, depth

    def estimates(self, hashes: np.ndarray) -> np.ndarray:
        """Never below the count of a key, or FULL."""
        rows = _loaded(self.folder, self.bits, self.depth)
        found = [row[at] for row, at in zip(rows, cells_of(hashes, self.bits, self.depth), strict=True)]
        return np.minimum.reduce(found)


@lru_cache(maxsize=1)
def _loaded(folder: str, bits: int, depth: int) -> np.ndarray:
    cells = np.zeros((depth, 1 << bits), np.uint8)
    size = _parts_of(bits) << PART_BITS
    for k in range((1 << bits) // size):
        try:
            cells[:, k * size : (k + 1) * size] = load(folder, str(k))[0].reshape(depth, -1)
        except FileNotFoundError:  # no key fell into it
            continue
    return cells


def count_sketch(df: DataFrame, keys: Callable, bits: int, depth: int = 2) -> Sketch:
    """The merged sketch of all that keys(batch) yields: arrays of 64-bit hashes and of their counts.

    A task holds one sketch and sends its parts that are not empty; parts of one file are
    merged one after the other as they come, so no task holds more than one file. No rows:
    an empty sketch.
    """
    folder = scratch_path(df.sparkSession, "sketch")
    parts = df.mapInArrow(_counting(keys, bits, depth), "file int, part int, cells binary")
    parts = parts.repartition(max(FILES, shuffle_partitions(df.sparkSession)), "file").sortWithinPartitions("file")
    parts.mapInArrow(_merging(folder, bits, depth), "file int").count()
    return Sketch(folder, bits, depth)
