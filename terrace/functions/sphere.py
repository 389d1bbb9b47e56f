"""Column expressions between points and range-image pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrace.config import THRESHOLDS, Thresholds


def range_m(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def azimuth_bin(x: Column, y: Column, th: Thresholds = THRESHOLDS) -> Column:
    return F.pmod(F.floor((F.atan2(y, x) + math.pi) / (2 * math.pi / th.azimuths)), F.lit(th.azimuths)).cast("int")


def elevation_bin(z: Column, r: Column, th: Thresholds = THRESHOLDS) -> Column:
    """Scan line from the top; outside 0 to rings - 1 beyond the field of view."""
    step = math.radians(th.phi_max_deg - th.phi_min_deg) / th.rings
    sine = F.least(F.greatest(z / F.greatest(r, F.lit(1e-9)), F.lit(-1.0)), F.lit(1.0))
    return F.floor((math.radians(th.phi_max_deg) - F.asin(sine)) / step).cast("int")


def clamp_bin(v: Column, th: Thresholds = THRESHOLDS) -> Column:
    return F.least(F.greatest(v, F.lit(0)), F.lit(th.rings - 1))


def in_view(v: Column, r: Column, th: Thresholds = THRESHOLDS) -> Column:
    return (v >= 0) & (v < th.rings) & (r > 1e-6)


def in_field_of_view(x: Column, y: Column, z: Column, th: Thresholds = THRESHOLDS) -> Column:
    flat = F.sqrt(x * x + y * y)
    phi = F.degrees(F.atan2(z - th.sensor_height_m, F.greatest(flat, F.lit(1e-9))))
    return (phi >= th.phi_min_deg) & (phi <= th.phi_max_deg) & (flat > 1.0)
