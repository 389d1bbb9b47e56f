"""Neighbourhood operators on the sparse lattice: gradients, steps, traversability, kerbs, potholes, confidence.

Cells stand in tiles with a halo as wide as the operator reaches, brought together by one
shuffle; a neighbour is then an offset of arrays. Only tiles that hold cells exist, and a
place without a cell is a gap, so nothing is filled in.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace import config as C
from terrace.config import THRESHOLDS, Schedule, Thresholds
from terrace.functions import lattice as L
from terrace.functions import measure as M
from terrace.operators.scatter import CELL
from terrace.operators.tiles import Tile, moved, on_tiles

#: Eight directions as steps (along y, along x), by octants of 45 degrees.
DIRECTIONS = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def _half(ring: Column, s: Schedule) -> Column:
    return L.by_ring(ring, [r.side // 2 for r in s.bands]).cast("bigint")


def _last(ring: Column, s: Schedule) -> Column:
    return L.by_ring(ring, [r.side - r.side // 2 - 1 for r in s.bands]).cast("bigint")


def _baselines(s: Schedule, baseline_m: float) -> list[int]:
    """Cells that a baseline spans, by ring."""
    return [C.baseline_cells(r.cell_m, baseline_m) for r in s.bands]


def _window(s: Schedule, ring: int) -> tuple[int, int]:
    """First and last cell of the ring's window, which lies around the origin."""
    side = s.bands[ring].side
    return -(side // 2), side - side // 2 - 1


def with_slopes(cells: DataFrame, s: Schedule = C.FOVEATED, th: Thresholds = THRESHOLDS) -> DataFrame:
    """Adds dzdx, dzdy (m per m), step_cm and all_seen. A missing neighbour counts as a stored height of 0, as an empty cell has; all_seen tells. Neighbours lie no further than the window, which holds all cells."""
    reach, sizes = _baselines(s, th.trav_baseline_m), [r.cell_m for r in s.bands]

    def slopes(t: Tile):
        k, (low, high), z, n = reach[t.ring], _window(s, t.ring), t.values["ground_cm"], t.values["obs_count"]
        ahead = lambda i: np.minimum(i + k, high)
        back = lambda i: np.maximum(i - k, low)
        at = lambda i, first, size: np.clip(i - first, 0, size - 1)
        rows, columns = (at(f(t.iy), t.y0, len(z)) for f in (ahead, back)), (at(f(t.ix), t.x0, len(z)) for f in (ahead, back))
        (north, south), (east, west) = rows, columns
        near = [(z[:, east], n[:, east]), (z[:, west], n[:, west]), (z[north], n[north]), (z[south], n[south])]
        span = lambda i: np.maximum(ahead(i) - back(i), 1) * sizes[t.ring] * 100.0
        (ze, _), (zw, _), (zn, _), (zs, _) = near
        seen = np.minimum.reduce([n, *(m for _, m in near)]) >= 1
        step = np.maximum.reduce([np.abs(v - z) for v, _ in near])
        return {"dzdx": ((ze - zw) / span(t.ix)[None, :], None), "dzdy": ((zn - zs) / span(t.iy)[:, None], None), "step_cm": (step, None), "all_seen": (seen, None)}

    return on_tiles(cells, ["ground_cm", "obs_count"], reach, slopes, "dzdx double, dzdy double, step_cm int, all_seen boolean")


def slope() -> Column:
    return F.sqrt(F.col("dzdx") * F.col("dzdx") + F.col("dzdy") * F.col("dzdy"))


def on_border(s: Schedule, k: Column | int = 1) -> Column:
    """Among the first or last k rows or columns of the ring's window around the origin."""
    ring, ix, iy = F.col("ring"), F.col("ix"), F.col("iy")
    low, high = -_half(ring, s) + k, _last(ring, s) - k
    return (ix < low) | (ix > high) | (iy < low) | (iy > high)


def traversability(cells: DataFrame, s: Schedule = C.FOVEATED, th: Thresholds = THRESHOLDS) -> DataFrame:
    """Adds `trav`, six bits of which 0 says that a vehicle can be there."""
    drivable = M.candidate(F.col("class_byte")).isin(*C.DRIVABLE)
    bits = (
        M.bit(F.col("ceiling_cm") - F.col("ground_cm") < th.vehicle_height_cm, C.TRAV_CLEARANCE)
        + M.bit(F.col("all_seen") & (slope() > th.tan_slope), C.TRAV_SLOPE)
        + M.bit(F.col("all_seen") & (F.col("step_cm") > th.max_step_cm), C.TRAV_STEP)
        + M.bit(M.decode_variance(F.col("var_code")) > th.max_variance_cm2, C.TRAV_ROUGHNESS)
        + M.bit(~drivable, C.TRAV_CLASS)
        + M.bit((F.col("obs_count") < th.min_obs) | on_border(s), C.TRAV_CONFIDENCE)
    )
    return with_slopes(cells, s, th).withColumn("trav", bits).drop("dzdx", "dzdy", "step_cm", "all_seen")


def confidence(cells: DataFrame, s: Schedule = C.FOVEATED, th: Thresholds = THRESHOLDS) -> DataFrame:
    """Margins of label, evidence, geometry and surface in 0 to 1, their least where drivable, and the channel that binds."""
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    n, blind = F.col("obs_count").cast("double"), F.col("flags").bitwiseAND(C.FLAG_BLIND) != 0
    drivable = M.candidate(F.col("class_byte")).isin(*C.DRIVABLE)
    out = with_slopes(cells, s, th).withColumns(
        {
            "label": F.when(n >= 1, unit((n + M.counter(F.col("class_byte"))) / (2.0 * n))).otherwise(0.0),
            "evidence": F.when(blind, 0.0).otherwise(unit(n / float(th.min_obs))),
            "geometry": unit(F.least(1.0 - slope() / th.tan_slope, 1.0 - F.col("step_cm") / float(th.max_step_cm))),
            "surface": unit(1.0 - M.decode_variance(F.col("var_code")) / th.max_variance_cm2),
        }
    )
    least = F.least("label", "evidence", "geometry", "surface")
    binding = F.when(~drivable, "not-drivable")
    for name in ("label", "evidence", "geometry", "surface"):
        binding = binding.when(F.col(name) == least, name)
    return out.withColumns({"confidence": F.when(drivable, least).otherwise(0.0), "binding": binding}).drop("dzdx", "dzdy", "step_cm", "all_seen")


def confidence_summary(cells: DataFrame) -> DataFrame:
    """Per ring over observed cells: count, mean, shares high and low, and the channel that binds most often, the first of several."""
    order = F.array_position(F.array(*map(F.lit, ("not-drivable", "label", "evidence", "geometry", "surface"))), F.col("binding"))
    seen = cells.where("obs_count >= 1")
    often = seen.groupBy("ring", "binding").agg(F.count(F.lit(1)).alias("c")).groupBy("ring").agg(F.max_by("binding", F.struct("c", -order)).alias("binding"))
    c = F.col("confidence")
    figures = seen.groupBy("ring").agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean"), F.avg((c >= 0.8).cast("double")).alias("high"), F.avg((c < 0.2).cast("double")).alias("low"))
    return figures.join(often, "ring")


def _observed() -> Column:
    return (F.col("obs_count") >= 1) & (F.col("flags").bitwiseAND(C.FLAG_BLIND) == 0)


def _inner(t: Tile, s: Schedule, k: int) -> np.ndarray:
    """Places that are not among the first or last k rows or columns of the ring's window."""
    low, high = _window(s, t.ring)
    inside = lambda i: (i >= low + k) & (i <= high - k)
    return inside(t.iy)[:, None] & inside(t.ix)[None, :]


def _kerbs(t: Tile, s: Schedule, th: Thresholds, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rise, octant and whether a place is on a kerb."""
    z = np.where(t.there, t.values["ground_cm"].astype(float), np.nan)
    dx, dy = moved(z, 0, k, np.nan) - moved(z, 0, -k, np.nan), moved(z, k, 0, np.nan) - moved(z, -k, 0, np.nan)
    rise = np.sqrt(dx * dx + dy * dy)
    octant = np.where(np.isnan(rise), 0, np.rint(np.arctan2(dy, dx) / (math.pi / 4))).astype(np.int64) % 8
    band = t.there & _inner(t, s, k) & (rise >= th.curb_cm[0]) & (rise <= th.curb_cm[1])
    marked, on = np.where(band, octant, -1), np.zeros_like(band)
    for o in range(8):
        step_y, step_x = DIRECTIONS[(o + 2) % 8]
        along = [moved(marked, sign * step_y, sign * step_x, -1) for sign in (1, -1)]
        aligned = [(a >= 0) & (np.abs((a - o + 4) % 8 - 4) <= 1) for a in along]
        on |= (marked == o) & aligned[0] & aligned[1]
    return rise, octant, on


def _holes(t: Tile, s: Schedule, th: Thresholds, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth, pairs of rim samples and whether a place is in a pothole."""
    z = np.where(t.there, t.values["ground_cm"].astype(float), np.nan)
    rim = np.stack([moved(z, -dy * r, -dx * r, np.nan) for dy, dx in DIRECTIONS])
    lacking = np.isnan(rim) | np.isnan(np.roll(rim, 4, axis=0))
    rim[lacking] = np.nan
    pairs = 4 - lacking[:4].sum(axis=0)
    rim.sort(axis=0)  # what lacks comes last
    pick = lambda k: np.take_along_axis(rim, np.clip(k, 0, 7)[None], axis=0)[0]
    # opposed samples come in pairs, so the median is the mean of the middle two
    median = (pick(pairs - 1) + pick(pairs)) / 2.0
    depth = median - z
    down = (median - rim > 0.5 * th.pothole_cm[0]).sum(axis=0)
    flat = pick(2 * pairs - 1) - rim[0] <= th.rim_spread_cm
    hole = t.there & _inner(t, s, r) & (pairs >= th.rim_pairs) & (depth >= th.pothole_cm[0]) & (depth <= th.pothole_cm[1]) & flat & (down <= th.rim_depressed * pairs)
    return depth, pairs, hole


def with_features(cells: DataFrame, s: Schedule = C.FOVEATED, th: Thresholds = THRESHOLDS) -> DataFrame:
    """ring, ix, iy of observed cells that are not blind, with rise_cm and octant of those on a kerb, depth_cm and rim_pairs of those in a pothole, nulls elsewhere: both in one exchange.

    A kerb is a rise within the band whose line goes on to both sides; a pothole lies below a
    flat rim that is seen on opposed sides.
    """
    across, around = _baselines(s, th.curb_baseline_m), [max(1, round(th.rim_m / x.cell_m)) for x in s.bands]
    halo = [max(k + 1, r) for k, r in zip(across, around, strict=True)]

    def both(t: Tile):
        rise, octant, kerb = _kerbs(t, s, th, across[t.ring])
        depth, pairs, hole = _holes(t, s, th, around[t.ring])
        return {"rise_cm": (rise, ~kerb), "octant": (octant, ~kerb), "depth_cm": (depth, ~hole), "rim_pairs": (pairs, ~hole)}

    return on_tiles(cells.where(_observed()).select(*CELL, "ground_cm"), ["ground_cm"], halo, both, "rise_cm double, octant int, depth_cm double, rim_pairs int")


def curbs(cells: DataFrame, s: Schedule = C.FOVEATED, th: Thresholds = THRESHOLDS) -> DataFrame:
    """ring, ix, iy, rise_cm, octant of cells on a kerb."""
    return with_features(cells, s, th).where("rise_cm IS NOT NULL").select(*CELL, "rise_cm", "octant")


def potholes(cells: DataFrame, s: Schedule = C.FOVEATED, th: Thresholds = THRESHOLDS) -> DataFrame:
    """ring, ix, iy, depth_cm, rim_pairs of cells in a pothole."""
    return with_features(cells, s, th).where("depth_cm IS NOT NULL").select(*CELL, "depth_cm", "rim_pairs")


def features(cells: DataFrame, s: Schedule = C.FOVEATED, th: Thresholds = THRESHOLDS) -> DataFrame:
    """Kerbs and potholes of all rings: kind, ring, ix, iy, size_cm."""
    kinds = F.array(F.struct(F.lit("curb").alias("kind"), F.col("rise_cm").alias("size_cm")), F.struct(F.lit("pothole").alias("kind"), F.col("depth_cm").alias("size_cm")))
    return with_features(cells, s, th).select(*CELL, F.inline(kinds)).where("size_cm IS NOT NULL").select("kind", *CELL, "size_cm")


def feature_summary(found: DataFrame) -> DataFrame:
    """kind, ring, n and the 10th, 50th and 90th percentile of the size."""
    q = F.percentile("size_cm", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return found.groupBy("kind", "ring").agg(F.count(F.lit(1)).alias("n"), q.alias("q")).select("kind", "ring", "n", F.col("q")[0].alias("p10"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p90"))
