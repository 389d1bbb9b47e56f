"""Folding frames into cell state: fusion of heights and classes, ageing, window resets, re-basing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace import config as C
from terrace.config import THRESHOLDS, Thresholds
from terrace.functions import measure as M
from terrace.operators.scatter import CELL

#: Cell state, in order, and its value in a cell that was never seen.
STATE = (
    ("ground_cm", "int", 0), ("ceiling_cm", "int", C.NO_CEILING), ("var_code", "int", 0), ("log_odds", "int", 0), ("class_byte", "int", 0),
    ("reflectivity", "int", 0), ("obs_count", "int", 0), ("frames_since_seen", "int", 0), ("flags", "int", 0), ("last_frame", "int", -1),
)
MEASURED = ["wz_sum", "w_sum", "n", "ceiling_cm", "refl_sum", "class_id"]


def empty_state() -> Column:
    return F.struct(*(F.lit(v).cast(t).alias(n) for n, t, v in STATE))


def _weighed(state: Column, seen: Column, th: Thresholds) -> dict[str, Column]:
    """The state's variance before the frame, the frame's height and its noise."""
    return {
        "before": M.decode_variance(state["var_code"]) + th.process_noise_cm2,
        "height": M.mean_height(seen["wz_sum"], seen["w_sum"]).cast("double"),
        "noise": float(th.weight_scale) / F.greatest(seen["w_sum"].cast("double"), F.lit(1.0)),
    }


def _fused(state: Column, seen: Column, before: Column, height: Column, noise: Column, gain: Column, th: Thresholds) -> dict[str, Column]:
    """The fields of the state after one frame's aggregate of the cell; gain: before / (before + noise)."""
    prior = state["ground_cm"].cast("double")
    first, ground = state["obs_count"] == 0, seen["w_sum"] > 0
    mu = F.when(~ground, prior).when(first, height).otherwise(prior + gain * (height - prior))
    var = F.when(~ground, before).when(first, noise).otherwise((1.0 - gain) * before)
    low, high = th.log_odds_clamp
    refl = (seen["refl_sum"] - F.pmod(seen["refl_sum"], seen["n"])) / seen["n"]
    return {
        "ground_cm": F.rint(mu), "ceiling_cm": F.least(state["ceiling_cm"], seen["ceiling_cm"]), "var_code": M.encode_variance(var),
        "log_odds": F.greatest(F.least(state["log_odds"] + th.log_odds_hit, F.lit(high)), F.lit(low)), "class_byte": M.vote(state["class_byte"], seen["class_id"]),
        "reflectivity": F.least(refl, F.lit(255)), "obs_count": F.least(state["obs_count"] + seen["n"], F.lit(255)), "frames_since_seen": F.lit(0),
        "flags": state["flags"], "last_frame": seen["frame"],
    }


def fuse(state: Column, seen: Column, th: Thresholds = THRESHOLDS) -> Column:
    """The state after one frame's aggregate of the cell."""
    w = _weighed(state, seen, th)
    values = _fused(state, seen, **w, gain=w["before"] / (w["before"] + w["noise"]), th=th)
    return F.struct(*(values[n].cast(t).alias(n) for n, t, _ in STATE))


def fold_frames(aggregates: DataFrame, by: list[str] = CELL) -> DataFrame:
    """Final state of every cell. aggregates: one row for each frame and cell; a cell's frames are folded in order within one row."""
    rows = aggregates.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("frame", *MEASURED))).alias("seen"))
    return _unpacked(rows, by, F.aggregate("seen", empty_state(), lambda acc, x: fuse(acc, x)))


def _unpacked(rows: DataFrame, by: list[str], state: Column) -> DataFrame:
    """The fields of a state as columns, by a generator: a filter on them is not moved before it, where it would compute the state once more for each field it asks for."""
    return rows.select(*by, F.inline(F.array(state)))


def merge_frame(state: DataFrame, aggregate: DataFrame, th: Thresholds = THRESHOLDS) -> DataFrame:
    """State after one more frame, cell by cell: the form of fold_frames for a running map. A full join on the cell, and shared figures as columns, which keeps the generated code short."""
    prior = state.select(*CELL, F.struct(*(n for n, _, _ in STATE)).alias("prior"))
    now = aggregate.select(*CELL, F.struct("frame", *MEASURED).alias("now"))
    both = prior.join(now, CELL, "full_outer").withColumn("prior", F.coalesce("prior", empty_state()))
    s, x = F.col("prior"), F.col("now")
    both = both.withColumns(_weighed(s, x, th)).withColumn("gain", F.col("before") / (F.col("before") + F.col("noise")))
    values = _fused(s, x, *(F.col(c) for c in ("before", "height", "noise", "gain")), th)
    return both.select(*CELL, *(F.when(x.isNull(), s[n]).otherwise(values[n].cast(t)).alias(n) for n, t, _ in STATE))


def last_islands(aggregates: DataFrame, windows: DataFrame) -> DataFrame:
    """Of each cell the aggregates since it last lay outside its ring's window: a cell that leaves the window starts anew.

    windows: frame, ring, x0, y0, side, one row a frame and ring; small, so that each cell's
    frames are looked up by an equi-join on the ring after grouping windows by ring.
    """
    frames = windows.groupBy("ring").agg(F.array_sort(F.collect_list(F.struct("frame", "x0", "y0", "side"))).alias("windows"))
    cells = aggregates.groupBy(*CELL).agg(F.collect_list(F.struct("frame", *MEASURED)).alias("seen"))
    outside = lambda w: ~(F.col("ix").between(w["x0"], w["x0"] + w["side"] - 1) & F.col("iy").between(w["y0"], w["y0"] + w["side"] - 1))
    gone = F.coalesce(F.array_max(F.transform(F.filter("windows", outside), lambda w: w["frame"])), F.lit(-1))
    kept = cells.join(frames, "ring").select(*CELL, F.explode(F.filter("seen", lambda x: x["frame"] > gone)).alias("x"))
    return kept.select("x.frame", *CELL, *(f"x.{m}" for m in MEASURED))


def windows_of(frames: DataFrame, s: C.Schedule) -> DataFrame:
    """frame, ring, x0, y0, side. frames: frame, ego_x, ego_y."""
    from terrace.functions.lattice import window_start

    rings = frames.withColumn("ring", F.explode(F.array(*(F.lit(r.number) for r in s.bands))))
    side = F.element_at(F.array(*(F.lit(r.side) for r in s.bands)), F.col("ring") + 1)
    return rings.select("frame", "ring", window_start(F.col("ego_x"), F.col("ring"), s).alias("x0"), window_start(F.col("ego_y"), F.col("ring"), s).alias("y0"), side.alias("side"))


def shift_costs(windows: DataFrame) -> DataFrame:
    """frame, ring, cells that the window's move since the frame before clears."""
    before = windows.select((F.col("frame") + 1).alias("frame"), "ring", F.col("x0").alias("px"), F.col("y0").alias("py"))
    dx, dy = F.least(F.abs(F.col("x0") - F.col("px")), F.col("side")), F.least(F.abs(F.col("y0") - F.col("py")), F.col("side"))
    kept = (F.col("side") - dx) * (F.col("side") - dy)
    return windows.join(before, ["frame", "ring"]).select("frame", "ring", (F.col("side").cast("bigint") * F.col("side") - kept).cast("bigint").alias("cleared"))


def rebase(ground_cm: Column, old_datum_m: Column, new_datum_m: Column) -> Column:
    """A stored height against a moved datum, clamped to the band again."""
    moved = ground_cm + ((old_datum_m - new_datum_m) * 100).cast("int")
    return F.greatest(F.least(moved, F.lit(C.Z_MAX_CM)), F.lit(C.Z_MIN_CM))


def aged(state: DataFrame, now: Column) -> DataFrame:
    """frames_since_seen as of a frame, up to 255."""
    return state.withColumn("frames_since_seen", F.least(now - F.col("last_frame"), F.lit(255)).cast("int"))


def mark_blind(state: DataFrame, x: Column, y: Column) -> DataFrame:
    """Sets the blind flag of cells whose centre lies within the sensor's blind cone."""
    return state.withColumn("flags", F.when(M.is_blind(x, y), F.col("flags").bitwiseOR(C.FLAG_BLIND)).otherwise(F.col("flags")))
