"""Conservative quad-tree reductions over each ring's window, and block queries on them.

The tree grows level by level: the six lowest levels of a tile of 64 x 64 cells in one task,
the few above from the tiles' tops. A box is covered by whole nodes, so a query reads about
as many nodes as its border has cells, not those of its area.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace import config as C
from terrace.config import Schedule
from terrace.shipping import ship_package

SAFE, BLOCKED, MIXED = 0, 1, 2


def level_sides(side: int) -> list[int]:
    out = [side]
    while out[-1] > 1:
        out.append((out[-1] + 1) // 2)
    return out


#: Levels that a task reduces by itself, and the node's reductions.
TILE_LEVELS = 6
REDUCED = "h_max int, h_min int, c_min int, n_min int, and_mask int, or_mask int, cells bigint"
NODE = f"ring int, level int, row bigint, col bigint, {REDUCED}"
_NAMES = [c.split()[0] for c in REDUCED.split(", ")]
#: How two nodes of a level become one, and what an empty one holds.
_JOINED = {"h_max": (np.maximum, -(1 << 31)), "h_min": (np.minimum, (1 << 31) - 1), "c_min": (np.minimum, (1 << 31) - 1), "n_min": (np.minimum, (1 << 31) - 1), "and_mask": (np.bitwise_and, -1), "or_mask": (np.bitwise_or, 0), "cells": (np.add, 0)}


def _window(ring: Column, s: Schedule) -> Column:
    return F.element_at(F.array(*(F.lit(x.side) for x in s.bands)), ring + 1)


def as_nodes(cells: DataFrame, s: Schedule = C.FOVEATED) -> DataFrame:
    """Cells (ring, ix, iy, ground_cm, ceiling_cm, obs_count, trav) as nodes of level 0."""
    half = F.floor(_window(F.col("ring"), s) / 2).cast("bigint")
    low = [F.col(c).cast("int").alias(n) for c, n in zip(("ground_cm", "ground_cm", "ceiling_cm", "obs_count", "trav", "trav"), _NAMES, strict=False)]
    return cells.select(F.col("ring").cast("int").alias("ring"), F.lit(0).alias("level"), (F.col("iy") + half).alias("row"), (F.col("ix") + half).alias("col"), *low, F.lit(1).cast("bigint").alias("cells"))


def _tile_levels(deepest: list[int]):
    """The nodes above a tile's nodes of one level, up to TILE_LEVELS levels on, by halving arrays."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ring, level, tile_row, tile_col = (k.as_py() for k in key)
        side = 1 << TILE_LEVELS
        y, x = rows.column("row").to_numpy() - tile_row * side, rows.column("col").to_numpy() - tile_col * side
        grid = {}
        for name in _NAMES:
            grid[name] = np.full((side, side), _JOINED[name][1], np.int64)
            grid[name][y, x] = rows.column(name).to_numpy()
        out = []
        for up in range(1, min(TILE_LEVELS, deepest[ring] - level) + 1):
            for name, (join, _) in _JOINED.items():
                g = grid[name]
                half = join(g[0::2], g[1::2])
                grid[name] = join(half[:, 0::2], half[:, 1::2])
            at_y, at_x = np.nonzero(grid["cells"])
            first = side >> up
            columns = {"ring": np.full(len(at_y), ring, np.int32), "level": np.full(len(at_y), level + up, np.int32), "row": at_y + tile_row * first, "col": at_x + tile_col * first}
            out.append(pa.table(columns | {n: grid[n][at_y, at_x].astype(np.int64 if n == "cells" else np.int32) for n in _NAMES}))
        return pa.concat_tables(out) if out else rows.select([c.split()[0] for c in NODE.split(", ")]).slice(0, 0)

    return run


def nodes(cells: DataFrame, s: Schedule = C.FOVEATED, levels: int | None = None) -> DataFrame:
    """ring, level, row, col and the six reductions, for blocks that hold an observed cell.

    cells: ring, ix, iy, ground_cm, ceiling_cm, obs_count, trav, around the origin, without
    repeats. `cells` tells how many were observed; a block with fewer than its area also holds
    cells never seen, so n_min and and_mask stand for it only together with that count. Each
    level comes from the one below: a third more rows than cells in all, and two exchanges,
    the second of one row for each 4096 cells.
    """
    ship_package(cells.sparkSession)
    depth = [len(level_sides(r.side)) - 1 for r in s.bands]
    deepest = [d if levels is None else min(d, levels) for d in depth]
    above = lambda df: df.groupBy("ring", "level", F.expr(f"shiftright(row, {TILE_LEVELS})").alias("tile_row"), F.expr(f"shiftright(col, {TILE_LEVELS})").alias("tile_col")).applyInArrow(_tile_levels(deepest), NODE)
    found = above(as_nodes(cells, s))
    if max(deepest) <= TILE_LEVELS:
        return found
    return found.unionAll(above(_tops(cells, s)))


def _tops(cells: DataFrame, s: Schedule) -> DataFrame:
    """The nodes of level TILE_LEVELS, by partial aggregation straight from the cells."""
    up = [F.expr(f"shiftright({c}, {TILE_LEVELS})").alias(c) for c in ("row", "col")]
    kinds = {"h_max": F.max, "h_min": F.min, "c_min": F.min, "n_min": F.min, "and_mask": F.bit_and, "or_mask": F.bit_or, "cells": F.sum}
    return as_nodes(cells, s).groupBy("ring", F.lit(TILE_LEVELS).alias("level"), *up).agg(*(f(n).alias(n) for n, f in kinds.items()))


def block_area(s: Schedule) -> Column:
    """Cells of the window in a node's block, fewer at the window's far edges."""
    side = F.element_at(F.array(*(F.lit(r.side) for r in s.bands)), F.col("ring") + 1)
    edge = lambda i: F.least(F.expr(f"shiftleft({i} + 1, level)"), side) - F.expr(f"shiftleft({i}, level)")
    return edge("row") * edge("col")


def classified(found: DataFrame, s: Schedule = C.FOVEATED) -> DataFrame:
    """Adds state: SAFE if all cells are seen and free of bits, BLOCKED if all share a bit, else MIXED. Cells never seen read as low confidence, class and roughness."""
    unseen = F.col("cells") < block_area(s)
    empty = C.TRAV_ROUGHNESS | C.TRAV_CLASS | C.TRAV_CONFIDENCE
    every = F.when(unseen, F.col("and_mask").bitwiseAND(empty)).otherwise(F.col("and_mask"))
    some = F.when(unseen, F.col("or_mask").bitwiseOR(empty)).otherwise(F.col("or_mask"))
    return found.withColumn("state", F.when(some == 0, SAFE).when(every != 0, BLOCKED).otherwise(MIXED))


def block_extent(found: DataFrame, s: Schedule = C.FOVEATED) -> DataFrame:
    """Adds ix_lo, iy_lo, ix_hi, iy_hi (exclusive): the cells under a node."""
    side = F.element_at(F.array(*(F.lit(r.side) for r in s.bands)), F.col("ring") + 1)
    half = F.floor(side / 2).cast("bigint")
    low = lambda i: F.expr(f"shiftleft({i}, level)") - half
    high = lambda i: F.least(F.expr(f"shiftleft({i} + 1, level)"), side) - half
    return found.withColumns({"ix_lo": low("col"), "iy_lo": low("row"), "ix_hi": high("col"), "iy_hi": high("row")})


def cover(boxes: DataFrame, s: Schedule = C.FOVEATED) -> DataFrame:
    """box_id, ring, level, row, col: the fewest whole nodes that make up each box (ring, ix_lo, iy_lo, ix_hi, iy_hi inclusive), clipped to the window.

    Blocks of a level that lie in the box form a rectangle; those whose parent lies in it too
    are left to the parent, so of each level only strips one block wide along the border stay.
    """
    side = _window(F.col("ring"), s)
    half = F.floor(side / 2).cast("bigint")
    clip = lambda c, low: F.greatest(F.least(F.col(c) + half, side.cast("bigint") - (1 if low else 0)), F.lit(0 if low else -1).cast("bigint"))
    inside = (F.col("ix_hi") + half >= 0) & (F.col("iy_hi") + half >= 0) & (F.col("ix_lo") + half < side) & (F.col("iy_lo") + half < side)
    at = boxes.where(inside).select("box_id", "ring", *(clip(c, True).alias(n) for c, n in (("ix_lo", "x0"), ("iy_lo", "y0"), ("ix_hi", "x1"), ("iy_hi", "y1"))))
    deep = F.element_at(F.array(*(F.lit(len(level_sides(r.side)) - 1) for r in s.bands)), F.col("ring") + 1)
    at = at.withColumn("level", F.explode(F.sequence(F.lit(0), deep)))
    # whole blocks of a level: from the first that begins in the box to the last that ends in it
    first = lambda c, level: F.expr(f"shiftright({c} + shiftleft(1, {level}) - 1, {level})")
    last = lambda c, level: F.expr(f"shiftright({c} + 1, {level}) - 1")
    top = F.col("level") == deep
    own = {n: f(n, "level") for n, f in (("x0", first), ("y0", first), ("x1", last), ("y1", last))}
    parent = {n: f(n, "(level + 1)") for n, f in (("x0", first), ("y0", first), ("x1", last), ("y1", last))}
    # a level's blocks, and in them those that the level above takes
    at = at.select("box_id", "ring", "level", *(c.alias(n) for n, c in own.items()), *((2 * parent[n] + (1 if n[1] == "1" else 0)).alias(f"p{n}") for n in parent), top.alias("top")).where("x0 <= x1 AND y0 <= y1")
    none = F.col("top") | (F.col("px0") > F.col("px1")) | (F.col("py0") > F.col("py1"))
    x0, y0, x1, y1, px0, py0, px1, py1 = (F.col(c) for c in ("x0", "y0", "x1", "y1", "px0", "py0", "px1", "py1"))
    strip = lambda a, b, c, d: F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    strips = F.when(none, F.array(strip(x0, x1, y0, y1))).otherwise(F.array(strip(x0, x1, y0, py0 - 1), strip(x0, x1, py1 + 1, y1), strip(x0, px0 - 1, py0, py1), strip(px1 + 1, x1, py0, py1)))
    at = at.select("box_id", "ring", "level", F.inline(F.filter(strips, lambda t: (t["a"] <= t["b"]) & (t["c"] <= t["d"]))))
    return at.withColumn("col", F.explode(F.sequence("a", "b"))).withColumn("row", F.explode(F.sequence("c", "d"))).select("box_id", "ring", "level", "row", "col")


#: What tells boxes apart.
BOUNDS = ["ring", "ix_lo", "iy_lo", "ix_hi", "iy_hi"]


def _each_once(boxes: DataFrame) -> DataFrame:
    """The different boxes, whose bounds are their box_id."""
    return boxes.select(*BOUNDS).distinct().withColumn("box_id", F.struct(*BOUNDS))


def _for_all(boxes: DataFrame, found: DataFrame) -> DataFrame:
    """What was found for different boxes, for every box_id. Merged, since a table of boxes is estimated by its files and may be far larger than that."""
    asked = boxes.select(F.col("box_id").alias("asked"), F.struct(*BOUNDS).alias("box_id"))
    sums = [F.sum(c).alias(c) for c in ("n", "visited") if c in found.columns]
    masks = [F.bit_or("or_mask").alias("or_mask"), F.bit_and("and_mask").alias("and_mask")]
    return asked.hint("merge").join(found, "box_id").groupBy(F.col("asked").alias("box_id")).agg(sums[0], *masks, *sums[1:])


def box_descent(cells: DataFrame, boxes: DataFrame, s: Schedule = C.FOVEATED) -> DataFrame:
    """box_id, n, or_mask, and_mask over the observed cells within each box, and visited: the nodes that were read for it. Boxes without an observed cell have no row.

    Nodes of boxes are many times the boxes, which no estimate knows: they meet the tree in a
    merge join, never as a broadcast. Equal boxes are covered once.
    """
    tree = as_nodes(cells, s).unionByName(nodes(cells, s))
    hit = cover(_each_once(boxes), s).hint("merge").join(tree, ["ring", "level", "row", "col"])
    found = hit.groupBy("box_id").agg(F.sum("cells").alias("n"), F.bit_or("or_mask").alias("or_mask"), F.bit_and("and_mask").alias("and_mask"), F.count(F.lit(1)).alias("visited"))
    return _for_all(boxes, found)


def box_query(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """box_id, n, or_mask, and_mask over the observed cells within each box (ring, ix_lo, iy_lo, ix_hi, iy_hi inclusive).

    Boxes and cells meet by tiles of 32 cells, so that the range join is an equi-join; a box
    names every tile that it touches, and equal boxes do so once.
    """
    tile = lambda c: F.floor(F.col(c) / 32).cast("bigint")
    keyed = _each_once(boxes).withColumn("tx", F.explode(F.sequence(tile("ix_lo"), tile("ix_hi")))).withColumn("ty", F.explode(F.sequence(tile("iy_lo"), tile("iy_hi"))))
    hit = cells.withColumns({"tx": tile("ix"), "ty": tile("iy")}).join(keyed.hint("merge"), ["ring", "tx", "ty"]).where(F.col("ix").between(F.col("ix_lo"), F.col("ix_hi")) & F.col("iy").between(F.col("iy_lo"), F.col("iy_hi")))
    found = hit.groupBy("box_id").agg(F.count(F.lit(1)).alias("n"), F.bit_or("trav").alias("or_mask"), F.bit_and("trav").alias("and_mask"))
    return _for_all(boxes, found)
