"""Splitting and merging cells, the gate that asks for finer cells, and the bounded pool that grants them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace import config as C
from terrace.config import THRESHOLDS, Schedule, Thresholds
from terrace.functions import lattice as L
from terrace.functions import measure as M
from terrace.operators.scatter import CELL


def merged(children: DataFrame, by: list[str]) -> DataFrame:
    """One parent for each group: mean and variance by the law of total variance, count-weighted, or plain where nobody counted.

    children: mu_m, sigma2_m2, n, flags, parent_id, parent_mu_m, parent_sigma2_m2, parent_n
    (the cell that a derived child came from, or nulls). A group whose children all still
    stand as one split left them gives that parent back.
    """
    w, mu = F.col("w"), F.col("mu_m")
    total = children.groupBy(*by).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("m"), F.min("n").alias("n"), F.bit_and("flags").alias("all_flags"), F.bit_or("flags").alias("any_flags"),
        (F.bool_and(F.coalesce(F.col("flags").bitwiseAND(C.FLAG_DERIVED) != 0, F.lit(False)) & F.col("parent_id").isNotNull() & (F.col("n") == F.col("parent_n"))) & (F.min("parent_id") == F.max("parent_id"))).alias("restore"),
        F.first("parent_mu_m").alias("old_mu"), F.first("parent_sigma2_m2").alias("old_sigma2"),
    )
    each = children.select(*by, "mu_m", "sigma2_m2", F.col("n").alias("count")).join(total, by)
    each = each.withColumn("w", F.when(F.col("total") > 0, F.col("count") / F.col("total")).otherwise(1.0 / F.col("m")))
    mean = each.groupBy(*by).agg(F.sum(w * mu).alias("mean"))
    spread = each.join(mean, by).groupBy(*by).agg(F.first("mean").alias("mean"), F.sum(w * F.col("sigma2_m2")).alias("within"), F.sum(w * (mu - F.col("mean")) * (mu - F.col("mean"))).alias("between"))
    keep = C.FLAG_DERIVED | C.FLAG_BLIND
    flags = F.col("all_flags").bitwiseAND(keep).bitwiseOR(F.col("any_flags").bitwiseAND(C.FLAG_DYNAMIC))
    restore = F.coalesce("restore", F.lit(False))
    return spread.join(total, by).select(
        *by, F.when(restore, F.col("old_mu")).otherwise(F.col("mean")).alias("mu_m"),
        F.when(restore, F.col("old_sigma2")).otherwise(F.col("within") + F.col("between")).alias("sigma2_m2"), "n", flags.alias("flags"), restore.alias("restored"),
    )


def children_of(cells: DataFrame, s: Schedule = C.FOVEATED, th: Thresholds = THRESHOLDS, slope: Column | None = None) -> DataFrame:
    """The cells that each cell splits into, a ring finer: child number, same mean, larger variance, derived. Ring 0 has none.

    A child's traversability is its parent's.
    """
    size = L.cell_size(F.col("ring"), s)
    finer = L.by_ring(F.col("ring"), [0.0, *(float(r.cell_m) for r in s.bands[:-1])])
    m = L.by_ring(F.col("ring"), [1, *(s.split(r.number) for r in s.bands[1:])])
    variance = M.inflate(M.decode_variance(F.col("var_code")) * 1e-4, F.lit(0.0) if slope is None else slope, size, finer, th)
    split = cells.where("ring >= 1").withColumns({"var_code": M.encode_variance(variance * 1e4), "flags": F.col("flags").bitwiseOR(C.FLAG_DERIVED).bitwiseAND(~C.FLAG_REFINED & 0xFF)})
    return split.withColumn("child", F.explode(F.sequence(F.lit(0), m * m - 1)))


def measured_again(flags: Column) -> Column:
    """A derived cell that was measured is derived no more."""
    return flags.bitwiseAND(~C.FLAG_DERIVED & 0xFF)


def gate(cells: DataFrame, transient: DataFrame | None = None, th: Thresholds = THRESHOLDS) -> DataFrame:
    """Adds dynamic and fires: cells of a class worth refining, cells with something moving, and uncertain edges."""
    moving = cells.withColumn("dynamic", F.lit(False)) if transient is None else cells.join(transient.select(*CELL, F.lit(True).alias("dynamic")).distinct(), CELL, "left").withColumn("dynamic", F.coalesce("dynamic", F.lit(False)))
    edge = (F.col("trav").bitwiseAND(C.TRAV_STEP | C.TRAV_SLOPE) != 0) & (M.decode_variance(F.col("var_code")) > th.max_variance_cm2)
    return moving.withColumn("fires", M.candidate(F.col("class_byte")).isin(*C.REFINE) | F.col("dynamic") | edge)


def levels_available(s: Schedule, ring: int, th: Thresholds = THRESHOLDS) -> int:
    cells, levels = 1, 0
    for r in range(ring, 0, -1):
        cells *= s.split(r) ** 2
        if cells > th.pool_cells:
            break
        levels += 1
    return levels


def pool_requests(gated: DataFrame, s: Schedule = C.FOVEATED, speed: float = 0.0, th: Thresholds = THRESHOLDS) -> DataFrame:
    """Cells that fire and can be refined, with the score by which the pool ranks them."""
    fit = L.by_ring(F.col("ring"), [levels_available(s, r.number, th) for r in s.bands]) >= 1
    x, y = L.centre(F.col("ix"), F.col("ring"), s), L.centre(F.col("iy"), F.col("ring"), s)
    score = M.priority(F.sqrt(x * x + y * y), F.col("dynamic"), M.time_to_collision(x, F.lit(float(speed))))
    return gated.where(F.col("fires") & fit).select(*CELL, score.alias("score"), L.slot(F.col("ix"), F.col("iy"), F.col("ring"), s).alias("slot"))


def admitted(requests: DataFrame, th: Thresholds = THRESHOLDS, by: list[str] | None = None) -> DataFrame:
    """The requests that a pool of fixed size keeps: the highest scores, the lower slot of equal ones.

    Ranked within a few hash groups first, so the last ranking sees a bounded number of rows
    from each task.
    """
    by = by or []
    order = [F.desc("score"), "slot"]
    part = Window.partitionBy(*by, F.pmod(F.xxhash64("slot"), F.lit(64))).orderBy(*order)
    local = requests.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= th.pool_blocks).drop("rank")
    if not by:
        return local.orderBy(*order).limit(th.pool_blocks)
    return local.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= th.pool_blocks).drop("rank")


def overtaken(blocks: DataFrame, s: Schedule = C.FOVEATED, speed: Column | None = None) -> DataFrame:
    """Blocks whose cell a finer ring serves by now. blocks: ring, levels, x, y (cell centre in the vehicle frame)."""
    return blocks.where(L.migrate_ring(F.col("x"), F.col("y"), s, F.col("ring"), speed) <= F.col("ring") - F.col("levels"))


BLOCK = "ring int, ix bigint, iy bigint, levels int, score double, slot bigint"


def pooled(blocks: DataFrame, requests: DataFrame, th: Thresholds = THRESHOLDS) -> DataFrame:
    """ring, ix, iy, score, slot, held, granted of a pool's blocks and a batch of requests after it was served.

    A request for a cell that holds a block only updates its score; the others take free
    blocks, then those of strictly lower scores, so the pool holds the highest scores, blocks
    before requests and lower slots before higher ones where these are equal. No more rows
    than twice the pool are ever ranked together.
    """
    key = [*CELL, "slot"]
    old = blocks.select(*key, F.col("score").alias("old"), F.lit(True).alias("held"))
    now = old.join(requests.select(*key, F.col("score").alias("new")), key, "full_outer").select(*key, F.coalesce("new", "old").alias("score"), F.coalesce("held", F.lit(False)).alias("held"))
    best = admitted(now.where(~F.col("held")).select(*key, "score"), th).withColumn("held", F.lit(False))
    order = Window.orderBy(F.desc("score"), F.desc("held"), "slot")
    served = now.where("held").unionByName(best).withColumn("granted", F.row_number().over(order) <= th.pool_blocks)
    refused = now.where(~F.col("held")).join(best.select(*key), key, "left_anti").withColumn("granted", F.lit(False))
    return served.unionByName(refused)


def apply_gate(cells: DataFrame, blocks: DataFrame, transient: DataFrame | None = None, s: Schedule = C.FOVEATED, speed: float = 0.0, th: Thresholds = THRESHOLDS, ego: tuple[float, float] = (0.0, 0.0)) -> dict[str, DataFrame]:
    """One frame of the gate, release first: blocks (BLOCK) whose cell a finer ring serves by now go, then firing cells ask, the pool grants, and granted cells split.

    Gives `blocks` after the frame, the new `children`, `cells` with the refined flag of what
    holds a block, and `counts`: released, fired, acquired, refused, evicted.
    """
    x, y = (L.centre(F.col(i), F.col("ring"), s) - e for i, e in zip(("ix", "iy"), ego, strict=True))
    placed = blocks.withColumns({"x": x, "y": y})
    gone = overtaken(placed, s, F.lit(float(speed))).select(*CELL, F.lit(True).alias("released"))
    kept = blocks.join(gone, CELL, "left_anti")
    requests = pool_requests(gate(cells, transient, th), s, speed, th)
    pool = pooled(kept, requests, th)
    held = pool.where("granted").select(*CELL, F.lit(1).alias("levels"), "score", "slot")
    fresh = pool.where("granted AND NOT held").select(*CELL)
    flagged = cells.join(held.select(*CELL, F.lit(True).alias("refined")), CELL, "left").withColumn("flags", F.when(F.col("refined"), F.col("flags").bitwiseOR(C.FLAG_REFINED)).otherwise(F.col("flags").bitwiseAND(~C.FLAG_REFINED & 0xFF))).drop("refined")
    counts = pool.agg(
        F.count_if(F.col("granted") & ~F.col("held")).alias("acquired"), F.count_if(~F.col("granted") & ~F.col("held")).alias("refused"), F.count_if(~F.col("granted") & F.col("held")).alias("evicted"),
    ).withColumn("one", F.lit(1)).join(gone.agg(F.count(F.lit(1)).alias("released")).withColumn("one", F.lit(1)), "one").join(requests.agg(F.count(F.lit(1)).alias("fired")).withColumn("one", F.lit(1)), "one").drop("one")
    return {"blocks": held, "children": children_of(cells.join(fresh, CELL, "left_semi"), s, th), "cells": flagged, "counts": counts}
