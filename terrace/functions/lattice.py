"""Column expressions of the lattice: rings, cells, windows, slots."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.config import Schedule

OUTSIDE = -1
REAR_FLOOR_M = 50.0


def floor_div(x: Column, c: float) -> Column:
    """x // c of floats: the largest whole n with n * c <= x, exactly, which floor(x / c) is not on cell borders; bigint.

    The quotient is only ever rounded up to a whole number, so one comparison settles it. c is
    split into a part of 30 bits and the rest, whose products with n are exact.
    """
    c = float(c)
    high, low = split(c)
    n = F.floor(x / F.lit(c))
    return n - F.when(x - n * F.lit(high) < n * F.lit(low), 1).otherwise(0)


def split(c: float) -> tuple[float, float]:
    """c as a sum of a number of 30 bits and one of 23."""
    fraction, power = math.frexp(c)
    high = math.ldexp(round(fraction * 2**30), power - 30)
    return high, c - high


def idiv(i: Column, k) -> Column:
    """Floor division of integers of less than 53 bits by a positive number."""
    return F.floor(i / (F.lit(k) if isinstance(k, int) else k))


def by_ring(ring: Column, values) -> Column:
    """The ring's value of a short list; null outside."""
    return reduce(lambda acc, kv: acc.when(ring == kv[0], F.lit(kv[1])), enumerate(values), F.when(F.lit(False), F.lit(values[0])))


def stretch(s: Schedule, speed: Column) -> tuple[Column, Column, Column]:
    """Forward, side and rear factors at a speed."""
    t = speed / s.at_ms
    return F.least(F.greatest(1.0 + s.ahead * t, F.lit(1.0)), F.lit(2.0)), 1.0 / (1.0 + s.aside * t), F.lit(float(s.behind))


def d_aniso(x: Column, y: Column, s: Schedule, speed: Column) -> Column:
    """Stretched Chebyshev distance from the vehicle."""
    forward, side, rear = stretch(s, speed)
    zero = F.lit(0.0)
    return F.greatest(F.greatest(x, zero) / forward, F.greatest(-x, zero) / rear, F.abs(y) / side)


def _at_or_below(d: Column, s: Schedule, beyond: int | None = None) -> Column:
    """How many rings' half widths a distance reaches; `beyond` where it reaches all."""
    return reduce(lambda a, r: a.when(d < float(r.reach_m), r.number), s.bands[1:], F.when(d < float(s.bands[0].reach_m), 0)).otherwise(len(s.bands) if beyond is None else beyond)


def in_map(x: Column, y: Column, s: Schedule) -> Column:
    """Whether some ring serves a point of the vehicle frame: ring_of(...) >= 0 in few operations, for filters, which the optimizer copies to where the data come from."""
    return F.greatest(F.abs(x), F.abs(y)) < float(s.bands[-1].reach_m)


def ring_of(x: Column, y: Column, s: Schedule, speed: Column | None = None) -> Column:
    """Ring that serves a point in the vehicle frame; -1 outside. A border belongs to the coarser ring."""
    n, distance = len(s.bands), F.greatest(F.abs(x), F.abs(y))
    if speed is None and s.behind == 1.0:  # nothing is stretched, and the floor behind the vehicle changes nothing
        return _at_or_below(distance, s, OUTSIDE).cast("int")
    geometric = _at_or_below(distance, s)
    ring = F.greatest(_at_or_below(d_aniso(x, y, s, F.lit(0.0) if speed is None else speed), s), geometric)
    if (floor := s.kept_behind) is not None:
        rear = (x < 0) & (F.abs(x) < REAR_FLOOR_M) & (geometric <= floor)
        ring = F.when(rear, F.least(ring, F.lit(floor))).otherwise(ring)
    return F.when(geometric >= n, OUTSIDE).otherwise(F.least(ring, F.lit(n - 1))).cast("int")


def migrate_ring(x: Column, y: Column, s: Schedule, current: Column, speed: Column | None = None) -> Column:
    """Ring with hysteresis: coarser only well beyond the current ring's border, finer as soon as within the next."""
    speed = F.lit(0.0) if speed is None else speed
    radii = [float(r.reach_m) for r in s.bands]
    d, target = d_aniso(x, y, s, speed), ring_of(x, y, s, speed)
    beyond = d > by_ring(current, [r * (1.0 + s.slack) for r in radii])
    within = d < by_ring(current, [-1.0, *radii[:-1]])
    return F.when(current == OUTSIDE, target).when(beyond, F.when(target == OUTSIDE, OUTSIDE).otherwise(F.greatest(target, current + 1))).when(within, target).otherwise(current).cast("int")


def cell_index(w: Column, ring: Column, s: Schedule) -> Column:
    """Cell of a world coordinate on its ring's lattice: the base lattice divided by whole numbers."""
    return idiv(floor_div(w, s.unit_m), by_ring(ring, [r.units for r in s.bands]).cast("bigint"))


def cell_size(ring: Column, s: Schedule) -> Column:
    return by_ring(ring, [float(r.cell_m) for r in s.bands])


def centre(i: Column, ring: Column, s: Schedule) -> Column:
    return (i + 0.5) * cell_size(ring, s)


def window_start(ego: Column, ring: Column, s: Schedule) -> Column:
    """First cell of a ring's window for a vehicle at that world coordinate: centred on the vehicle's cell of the ring."""
    size = cell_size(ring, s)
    return F.floor(ego / size).cast("bigint") - by_ring(ring, [r.side // 2 for r in s.bands]).cast("bigint")


def in_window(i: Column, start: Column, ring: Column, s: Schedule) -> Column:
    side = by_ring(ring, [r.side for r in s.bands])
    return (i >= start) & (i < start + side)


def slot(ix: Column, iy: Column, ring: Column, s: Schedule) -> Column:
    """Position in ring-after-ring storage with wrap-around addressing; for outputs only."""
    side = by_ring(ring, [r.side for r in s.bands]).cast("bigint")
    offset = by_ring(ring, [r.first for r in s.bands]).cast("bigint")
    return offset + F.pmod(iy, side) * side + F.pmod(ix, side)


def annulus_index(ix: Column, iy: Column, side: int, low: int, high: int) -> Column:
    """Position in storage without the hole low..high: the rows above it, below it, left and right of it; -1 in the hole and outside."""
    above, beside = low * side, (high - low)
    inside = ix.between(0, side - 1) & iy.between(0, side - 1)
    below_at = above
    left_at = below_at + (side - high) * side
    right_at = left_at + beside * low
    return (
        F.when(~inside, -1)
        .when(iy < low, iy * side + ix)
        .when(iy >= high, below_at + (iy - high) * side + ix)
        .when(ix < low, left_at + (iy - low) * low + ix)
        .when(ix >= high, right_at + (iy - low) * (side - high) + (ix - high))
        .otherwise(-1)
        .cast("bigint")
    )


def with_ring(rows: DataFrame, ring: Column) -> DataFrame:
    return rows.withColumn("ring", ring)


def with_cells(points: DataFrame, s: Schedule, xw: Column, yw: Column, ring: Column) -> DataFrame:
    """Adds ring, ix, iy of world coordinates; ix and iy are null outside the map."""
    fine = points.withColumns({"ring": ring, "ix": floor_div(xw, s.unit_m), "iy": floor_div(yw, s.unit_m)})
    k = by_ring(F.col("ring"), [r.units for r in s.bands]).cast("bigint")
    return fine.withColumns({"ix": idiv(F.col("ix"), k), "iy": idiv(F.col("iy"), k)})
