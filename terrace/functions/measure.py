"""Column expressions of measurements: fixed-point heights and weights, the variance code, classes, occupancy, costs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrace import config as C
from terrace.config import THRESHOLDS, Thresholds

VAR_MAX, VAR_MIN, LAST_CODE = 640_000.0, 1.0 / 12.0, 255
LOG_RANGE = math.log(VAR_MAX / VAR_MIN)


def variance_cm2(r: Column, th: Thresholds = THRESHOLDS) -> Column:
    """Height variance of a return at range r."""
    r = F.greatest(r, F.lit(1e-3))
    q = F.lit(th.sensor_height_m) / r
    return (q * q * (th.sigma_r_m * th.sigma_r_m) + r * r * (th.sigma_phi_rad * th.sigma_phi_rad)) * 1e4


def weight(variance: Column, th: Thresholds = THRESHOLDS) -> Column:
    w = F.rint(float(th.weight_scale) / F.greatest(variance, F.lit(1e-9)))
    return F.least(F.greatest(w, F.lit(1.0)), F.lit(float(th.weight_max))).cast("int")


def height_cm(z: Column, datum: Column | None = None) -> Column:
    cm = z * 100.0 if datum is None else z * 100.0 - datum * 100.0
    return F.least(F.greatest(F.rint(cm), F.lit(float(C.Z_MIN_CM))), F.lit(float(C.Z_MAX_CM))).cast("int")


def mean_height(wz: Column, w: Column) -> Column:
    """Weighted mean of integers, half away from zero; 0 without weight."""
    w = F.greatest(w, F.lit(1).cast("bigint"))
    return (F.signum(wz).cast("bigint") * F.call_function("div", 2 * F.abs(wz) + w, 2 * w)).cast("int")


def decode_variance(code: Column) -> Column:
    return VAR_MAX * F.exp(code.cast("double") * (-LOG_RANGE) / float(LAST_CODE))


def encode_variance(variance: Column) -> Column:
    """Rounds to the next larger variance that a code stands for."""
    exact = F.log(VAR_MAX / F.greatest(variance, F.lit(1e-12))) * float(LAST_CODE) / LOG_RANGE
    return F.least(F.greatest(F.floor(exact), F.lit(0)), F.lit(LAST_CODE)).cast("int")


def pack_class(candidate: Column, counter: Column) -> Column:
    bad = (candidate > 31) | (counter > 7)
    return F.when(bad, F.raise_error(F.lit("class or counter out of range")).cast("int")).otherwise(F.shiftleft(candidate, 3).bitwiseOR(counter)).cast("int")


def candidate(packed: Column) -> Column:
    return F.shiftright(packed, 3)


def counter(packed: Column) -> Column:
    return packed.bitwiseAND(7)


def vote(packed: Column, observed: Column) -> Column:
    """One step of the saturating majority vote."""
    c, n = candidate(packed), counter(packed)
    return (
        F.when(n == 0, F.shiftleft(observed, 3).bitwiseOR(1))
        .when(c == observed, F.shiftleft(c, 3).bitwiseOR(F.least(n + 1, F.lit(7))))
        .otherwise(F.shiftleft(c, 3).bitwiseOR(n - 1))
        .cast("int")
    )


def raw_class(label: Column) -> Column:
    return label.bitwiseAND(0xFFFF)


def learning_id(label: Column, missing: int = -1) -> Column:
    """Class of a raw label word; `missing` where there is none. The live map's and the evaluation's unlabelled class is 31."""
    by_label = [C.RAW_TO_LEARNING.get(k, 19) for k in range(max(C.RAW_TO_LEARNING) + 1)]
    known = F.array(*(F.lit(None if v == 19 else v).cast("int") for v in by_label))
    return F.coalesce(F.get(known, raw_class(label)), F.lit(missing))


def is_moving(label: Column) -> Column:
    return raw_class(label).between(*C.MOVING_RAW)


def is_ground(cls: Column) -> Column:
    return cls.isin(*C.GROUND_CLASSES)


def occupancy(n: Column, log_odds: Column, flags: Column, th: Thresholds = THRESHOLDS) -> Column:
    return F.when((flags.bitwiseAND(C.FLAG_BLIND) != 0) | (n < 1), C.UNKNOWN).when(log_odds > th.log_odds_occupied, C.OCCUPIED).otherwise(C.FREE).cast("int")


def is_blind(x: Column, y: Column, th: Thresholds = THRESHOLDS) -> Column:
    return F.sqrt(x * x + y * y) < th.blind_cone_m


def bit(test: Column, value: int) -> Column:
    return F.when(test, value).otherwise(0)


def cost_from_bits(trav: Column, unknown: Column, th: Thresholds = THRESHOLDS) -> Column:
    """Planning cost of a cell; infinite where it cannot be entered."""
    has = lambda b: trav.bitwiseAND(b) != 0
    cost = th.w_base + F.when(has(C.TRAV_ROUGHNESS), th.w_roughness).otherwise(0.0) + F.when(has(C.TRAV_CLASS), th.w_class).otherwise(0.0) + F.when(unknown | has(C.TRAV_CONFIDENCE), th.w_unknown).otherwise(0.0)
    return F.when(has(C.TRAV_CLEARANCE | C.TRAV_SLOPE | C.TRAV_STEP), F.lit(float("inf"))).otherwise(cost)


def inflate(variance_m2: Column, slope: Column, parent_m: Column, child_m: Column, th: Thresholds = THRESHOLDS) -> Column:
    """Variance of the cells that a cell splits into; null where they would not be finer."""
    return F.when(child_m < parent_m, variance_m2 + th.kappa * slope * slope * (parent_m * parent_m - child_m * child_m) + th.alpha_m2)


def priority(range_m: Column, dynamic: Column, ttc_s: Column) -> Column:
    closeness = 1.0 / (1.0 + F.greatest(range_m, F.lit(0.0)) / 10.0)
    urgency = F.when(ttc_s >= 0, F.greatest(1.0 / (1.0 + ttc_s / 3.0), F.lit(0.05))).otherwise(1.0)
    return closeness * F.when(dynamic, 4.0).otherwise(1.0) * urgency


def time_to_collision(x: Column, speed: Column) -> Column:
    return F.when((speed > 1e-6) & (x > 0), x / speed).otherwise(F.lit(float("inf")))


def clear_tolerance(r: Column, th: Thresholds = THRESHOLDS) -> Column:
    q = F.lit(th.sensor_height_m) / F.greatest(r, F.lit(1e-3))
    return F.greatest(3.0 * F.sqrt(r * r * (th.sigma_phi_rad * th.sigma_phi_rad) + q * q * (th.sigma_r_m * th.sigma_r_m)), F.lit(th.clear_floor_m))


def azimuth_spacing(r: Column) -> Column:
    """Distance between neighbouring returns along a scan line, for a step of 0.2 degrees."""
    return r * (0.2 * math.pi / 180)


def radial_spacing(r: Column, th: Thresholds = THRESHOLDS) -> Column:
    """Distance between scan lines on flat ground; it grows with the square of the range."""
    return r * r * ((26.9 / 63) * math.pi / 180) / th.sensor_height_m


def fill_probability(r: Column, cell_m: Column) -> Column:
    one = F.lit(1.0)
    return F.least(one, cell_m / radial_spacing(r)) * F.least(one, cell_m / azimuth_spacing(r))
