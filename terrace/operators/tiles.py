"""Cells as dense arrays: square tiles with a halo of the cells around them.

A cell is a row; a tile is the rows of TILE x TILE cells and of the halo around them, as
numpy arrays. Cells near a tile's edge are copied to the tiles whose halo they lie in, in
the one shuffle that brings tiles together; every offset is then an array operation. A
tile's rows are bounded, so a group always fits a task, however large the map.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrace.shipping import ship_package

TILE = 64


class Tile:
    """Arrays [iy, ix] of one tile and its halo. Places where no cell is read 0."""

    def __init__(self, ring: int, x0: int, y0: int, there: np.ndarray, values: dict[str, np.ndarray]):
        self.ring, self.x0, self.y0, self.there, self.values = ring, x0, y0, there, values

    @property
    def ix(self) -> np.ndarray:
        return self.x0 + np.arange(self.there.shape[1])

    @property
    def iy(self) -> np.ndarray:
        return self.y0 + np.arange(self.there.shape[0])


def moved(a: np.ndarray, dy: int, dx: int, fill=0) -> np.ndarray:
    """The values dy rows and dx columns further on; `fill` beyond the edge."""
    out = np.full_like(a, fill)
    h, w = a.shape
    if abs(dy) < h and abs(dx) < w:
        out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return out


def on_tiles(cells: DataFrame, values: list[str], halo: list[int], compute: Callable[[Tile], dict[str, tuple[np.ndarray, np.ndarray | None]]], added: str) -> DataFrame:
    """cells with further columns: compute(tile) gives an array over the tile and its halo for each, and where it is null (None: nowhere).

    values: the whole-number columns that tiles hold. halo: cells around a tile, by ring, TILE
    at most. added: the columns in DDL. Repeated cells are not expected; all other columns
    pass through. One exchange.
    """
    ship_package(cells.sparkSession)
    taken = {c.lower() for c in cells.columns}
    tx, ty = (next(n for n in (f"{'_' * k}{name}" for k in range(9)) if n not in taken) for name in ("tx", "ty"))
    reach = F.element_at(F.array(*map(F.lit, halo)), F.col("ring") + 1)

    def tiles(i: str):
        at, inside = F.floor(F.col(i) / TILE), F.pmod(F.col(i), F.lit(TILE))
        return F.filter(F.array(F.when(inside < reach, at - 1), at, F.when(inside >= TILE - reach, at + 1)), lambda t: t.isNotNull())

    copies = cells.withColumn(tx, F.explode(tiles("ix"))).withColumn(ty, F.explode(tiles("iy")))
    extra = StructType.fromDDL(added)
    names, schema = cells.columns, StructType(cells.schema.fields + extra.fields)
    kinds = {"double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "bigint": pa.int64()}
    columns = [(f.name, kinds[f.dataType.simpleString()]) for f in extra.fields]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ring, at_x, at_y = (k.as_py() for k in key)
        h = halo[ring]
        side, x0, y0 = TILE + 2 * h, at_x * TILE - h, at_y * TILE - h
        x, y = (rows.column(c).to_numpy() - o for c, o in (("ix", x0), ("iy", y0)))
        there = np.zeros((side, side), bool)
        there[y, x] = True
        arrays = {}
        for name in values:
            arrays[name] = np.zeros((side, side), np.int64)
            arrays[name][y, x] = rows.column(name).to_numpy()
        own = (x >= h) & (x < h + TILE) & (y >= h) & (y < h + TILE)
        found = compute(Tile(ring, x0, y0, there, arrays))
        out = rows.select(names).filter(pa.array(own))
        for name, kind in columns:
            array, null = found[name]
            out = out.append_column(name, pa.array(array[y[own], x[own]], mask=None if null is None else null[y[own], x[own]]).cast(kind))
        return out

    return copies.groupBy("ring", tx, ty).applyInArrow(run, schema)


