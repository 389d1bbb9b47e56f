"""Schedules, thresholds and classes: driver-side values that expressions bake in as literals."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, fields, replace

# Fixed values of the cell encoding and the sensor.
TRAV_CLEARANCE, TRAV_SLOPE, TRAV_STEP, TRAV_ROUGHNESS, TRAV_CLASS, TRAV_CONFIDENCE = 1, 2, 4, 8, 16, 32
FLAG_DERIVED, FLAG_REFINED, FLAG_BLIND, FLAG_DYNAMIC = 1, 2, 4, 8
UNKNOWN, FREE, OCCUPIED = 0, 1, 2
NO_CEILING = 32767
Z_MIN_CM, Z_MAX_CM = -200, 600
UNLABELLED = 31
CELL_BYTES, TRANSIENT_BYTES, TRACK_BYTES, NODE_BYTES = 12, 4, 20, 9
# Class names, the index is the learning id.
CLASS_NAMES = (
    "car", "bicycle", "motorcycle", "truck", "other-vehicle", "person", "bicyclist", "motorcyclist", "road", "parking",
    "sidewalk", "other-ground", "building", "fence", "vegetation", "trunk", "terrain", "pole", "traffic-sign", "unlabeled",
)
# Raw label to learning id; raw labels that are not listed, or map to 19, have none.
RAW_TO_LEARNING = {
    0: 19, 1: 19, 10: 0, 11: 1, 13: 4, 15: 2, 16: 4, 18: 3, 20: 4, 30: 5, 31: 6, 32: 7, 40: 8, 44: 9, 48: 10, 49: 11, 50: 12,
    51: 13, 52: 19, 60: 8, 70: 14, 71: 15, 72: 16, 80: 17, 81: 18, 99: 19, 252: 0, 253: 6, 254: 5, 255: 7, 256: 4, 257: 4, 258: 3, 259: 4,
}
DRIVABLE = tuple(CLASS_NAMES.index(x) for x in ("road", "parking", "sidewalk", "other-ground", "terrain"))
REFINE = tuple(CLASS_NAMES.index(x) for x in ("person", "bicyclist", "motorcyclist", "pole", "traffic-sign", "bicycle", "motorcycle"))
GROUND_CLASSES = (8, 9, 10, 11, 16)
MOVING_RAW = (250, 259)


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Band:
    """One ring of a schedule, with what follows from its reach and cell: base cells along a cell, cells along its full square and along the hole that finer rings serve, and the first slot where full squares are stored one after another."""

    number: int
    reach_m: float
    cell_m: float
    units: int
    side: int
    hole: int
    first: int

    @property
    def cells(self) -> int:
        return self.side**2 - self.hole**2


@dataclass(frozen=True)
class Schedule:
    """Rings from fine to coarse around the vehicle. With speed, distances ahead count less and those aside more (ahead and aside per at_ms); behind, rings up to cells of fine_behind_m are kept; a cell changes to a coarser ring only `slack` beyond its border."""

    name: str
    unit_m: float
    bands: tuple[Band, ...]
    slack: float = 0.1
    ahead: float = 1.0
    aside: float = 0.5
    behind: float = 1.0
    at_ms: float = 15.0
    fine_behind_m: float = 0.20

    def split(self, number: int) -> int:
        """Cells of the next finer ring along one of this ring's."""
        return self.bands[number].units // self.bands[number - 1].units

    @property
    def kept_behind(self) -> int | None:
        """The coarsest ring that is kept behind the vehicle; None where all or none are."""
        fine = [b.number for b in self.bands if b.cell_m <= self.fine_behind_m + 1e-9]
        return max(fine) if 0 < len(fine) < len(self.bands) else None


def whole(value: float, what: str) -> int:
    if round(value) < 1 or abs(value - round(value)) > 1e-9:
        raise ConfigError(f"{what}: {value} is no whole number")
    return round(value)


def schedule(name: str, rings: tuple[tuple[float, float], ...], unit_m: float = 0.05, cells: tuple[int | None, ...] = (), **more: float) -> Schedule:
    """A schedule of (reach, cell) in metres, whose cells nest; `cells`, where given, are checked against what follows."""
    bands: list[Band] = []
    for n, (reach, cell) in enumerate(rings):
        inner = bands[-1] if bands else None
        units, side = whole(cell / unit_m, f"ring {n}, base cells"), whole(2 * reach / cell, f"ring {n}, cells along its side")
        if inner and (reach <= inner.reach_m or units % inner.units):
            raise ConfigError(f"ring {n} does not continue ring {n - 1}: reaches must increase and cells nest")
        bands.append(Band(n, reach, cell, units, side, round(2 * inner.reach_m / cell) if inner else 0, inner.first + inner.side**2 if inner else 0))
    if wrong := [b.number for b, n in zip(bands, cells, strict=False) if n not in (None, b.cells)]:
        raise ConfigError(f"{name}: rings {wrong} have other numbers of cells than stated")
    return Schedule(name, unit_m, tuple(bands), **more)


def notes(s: Schedule, azimuth_deg: float = 0.2) -> list[str]:
    """Rings whose cells are far from the spacing of returns along a scan line at their border."""
    spacing = [b.reach_m * math.radians(azimuth_deg) for b in s.bands]
    return [f"ring {b.number}: cell {b.cell_m} m against an azimuth spacing of {x:.3f} m" for b, x in zip(s.bands, spacing, strict=True) if not 0.5 <= b.cell_m / x <= 2]


def parse_schedule(text: str) -> Schedule:
    """A schedule from JSON: name, rings (reach_m, cell_m and, if wanted, cells), and any of unit_m, slack, ahead, aside, behind, at_ms, fine_behind_m."""
    given = json.loads(text)
    rings, name = given.pop("rings", None), given.pop("name", None)
    allowed = {f.name for f in fields(Schedule)} - {"name", "bands"}
    if not rings or not name or given.keys() - allowed:
        raise ConfigError(f"a schedule has a name and rings, and of {sorted(allowed)} what it likes; not {sorted(given.keys() - allowed)}")
    stated = tuple(r.get("cells") for r in rings)
    return schedule(name, tuple((r["reach_m"], r["cell_m"]) for r in rings), cells=stated, **given)


FOVEATED = schedule("5_10_20_40", ((10, 0.05), (25, 0.10), (50, 0.20), (100, 0.40)), cells=(160_000, 210_000, 187_500, 187_500))
THREE_RINGS = schedule("5_10_50", ((10, 0.05), (25, 0.10), (100, 0.50)), cells=(160_000, 210_000, 150_000), fine_behind_m=0.50)
SCHEDULES = {s.name: s for s in (FOVEATED, THREE_RINGS)}


def load(name: str) -> Schedule:
    if name not in SCHEDULES:
        raise ConfigError(f"no schedule {name!r}; there are {', '.join(SCHEDULES)}")
    return SCHEDULES[name]


def uniform(cell_m: float, half_width_m: float) -> Schedule:
    """One ring of one cell size."""
    return schedule(f"uniform_{round(cell_m * 100)}cm", ((half_width_m, cell_m),), unit_m=cell_m)


@dataclass(frozen=True)
class Thresholds:
    # traversability
    vehicle_height_cm: int = 180
    tan_slope: float = 0.36397023426620234  # of 20 degrees
    max_step_cm: int = 15
    trav_baseline_m: float = 0.50
    max_variance_cm2: float = 25.0
    min_obs: int = 3
    # features
    curb_cm: tuple[float, float] = (5.0, 25.0)
    curb_baseline_m: float = 0.20
    pothole_cm: tuple[float, float] = (8.0, 50.0)
    rim_m: float = 0.75
    rim_pairs: int = 2
    rim_depressed: float = 0.5
    rim_spread_cm: float = 8.0
    # occupancy and fusion
    log_odds_hit: int = 4
    log_odds_miss: int = -2
    log_odds_clamp: tuple[int, int] = (-64, 63)
    log_odds_occupied: int = 0
    process_noise_cm2: float = 0.1  # 1e-4 m2/s over one frame of 0.1 s
    frame_s: float = 0.1
    # split and merge
    kappa: float = 0.0625
    alpha_m2: float = 0.0
    # sensor
    sensor_height_m: float = 1.73
    phi_min_deg: float = -24.8
    phi_max_deg: float = 2.0
    rings: int = 64
    azimuths: int = 512
    blind_cone_m: float = 3.74
    sigma_r_m: float = 0.02
    sigma_phi_rad: float = 0.0017453292519943296  # 0.1 degrees
    # scatter
    weight_scale: int = 1024
    weight_max: int = 1 << 20
    max_points: int = 150_000
    # planning
    plan_cell_m: float = 0.25
    w_base: float = 1.0
    w_roughness: float = 2.0
    w_class: float = 3.0
    w_unknown: float = 4.0
    corridor_tau: float = 5.0
    # visibility, tracks, pool
    clear_floor_m: float = 0.30
    track_gate_m: float = 2.5
    track_ttl_frames: int = 10
    track_capacity: int = 256
    pool_blocks: int = 512
    pool_cells: int = 16

    def digest(self) -> str:
        """SHA-256 of all values; a run that compares schedules can refuse to start if it moved."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


THRESHOLDS = Thresholds()


def parse_thresholds(text: str, base: Thresholds = THRESHOLDS) -> Thresholds:
    """Thresholds from a JSON object that names those that differ from base; pairs are lists of two."""
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items()}
    if unknown := given.keys() - {f.name for f in fields(Thresholds)}:
        raise ConfigError(f"no such thresholds: {sorted(unknown)}")
    return replace(base, **given)


def class_name(number: int) -> str:
    """Name of a learning id; the stored unlabelled class and ids without a name are unlabelled. Ids that five bits cannot hold are refused."""
    if not 0 <= number <= UNLABELLED:
        raise ConfigError(f"class {number} is outside 0 to {UNLABELLED}")
    return CLASS_NAMES[number] if number < len(CLASS_NAMES) else CLASS_NAMES[-1]


def frozen(expected: str, th: Thresholds = THRESHOLDS) -> Thresholds:
    if th.digest() != expected:
        raise ConfigError("thresholds moved since they were frozen")
    return th


def baseline_cells(cell_m: float, baseline_m: float) -> int:
    """Half the baseline in cells, half to even, at least one."""
    return max(1, round(baseline_m / (2 * cell_m)))


def with_plan_cell(cell_m: float) -> Thresholds:
    return replace(THRESHOLDS, plan_cell_m=cell_m)
