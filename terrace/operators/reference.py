"""The offline reference map, and how a foveated map compares to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace import config as C
from terrace.config import Schedule
from terrace.functions import lattice as L
from terrace.functions import measure as M
from terrace.operators.scatter import CELL


def reference_map(points: DataFrame, cell_m: float = 0.05, xw: str = "x", yw: str = "y") -> DataFrame:
    """i, j, height_cm, count, class_id (raw) of static ground returns on one fine lattice.

    Heights are summed as whole micrometres, so the mean does not depend on the order of
    rows. The class is that of the first frame that has one, by its last return there.
    """
    i, j = (F.floor(F.col(c) / cell_m).cast("bigint") for c in (xw, yw))
    raw = M.raw_class(F.col("raw_label")).bitwiseAND(255)
    static = points.where(~F.col("moving") & F.col("ground")).select("frame", "point_id", i.alias("i"), j.alias("j"), F.rint(F.col("z") * 1e6).cast("bigint").alias("um"), raw.alias("raw"))
    frames = static.groupBy("i", "j", "frame").agg(F.sum("um").alias("um"), F.count(F.lit(1)).alias("count"), F.max(F.struct("point_id", "raw"))["raw"].alias("raw"))
    return frames.groupBy("i", "j").agg((F.sum("um") / F.sum("count") / 1e4).alias("height_cm"), F.sum("count").alias("count"), F.coalesce(F.min(F.when(F.col("raw") != 0, F.struct("frame", "raw")))["raw"], F.lit(0)).alias("class_id"))


def block_stats(ref: DataFrame, k: Column, by: list[str]) -> DataFrame:
    """Per block of k by k fine cells: observed cells n, mean and population variance of their heights. by: extra keys that ref carries."""
    key = [L.idiv(F.col("i"), k).alias("bi"), L.idiv(F.col("j"), k).alias("bj")]
    h = F.col("height_cm")
    return ref.groupBy(*by, *key).agg(F.count(F.lit(1)).alias("n_ref"), F.avg(h).alias("ref_mean"), F.var_pop(h).alias("ref_var"))


def ring_blocks(ref: DataFrame, s: Schedule = C.FOVEATED) -> DataFrame:
    """Block statistics under the cells of every ring: ring, ix, iy, n_ref, ref_mean, ref_var."""
    rings = ref.withColumn("ring", F.explode(F.array(*(F.lit(r.number) for r in s.bands))))
    k = L.by_ring(F.col("ring"), [r.units for r in s.bands]).cast("bigint")
    return block_stats(rings, k, ["ring"]).select("ring", F.col("bi").alias("ix"), F.col("bj").alias("iy"), "n_ref", "ref_mean", "ref_var")


def block_class(ref: DataFrame, k: int) -> DataFrame:
    """bi, bj, class_id: the class of most fine cells of a block, the smallest of several."""
    votes = ref.groupBy(L.idiv(F.col("i"), k).alias("bi"), L.idiv(F.col("j"), k).alias("bj"), "class_id").agg(F.count(F.lit(1)).alias("c"))
    return votes.groupBy("bi", "bj").agg(F.max(F.struct("c", (-F.col("class_id")).alias("m")))["m"].alias("m")).select("bi", "bj", (-F.col("m")).alias("class_id"))


def served(cells: DataFrame, s: Schedule = C.FOVEATED, ego: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Cells whose centre their own ring serves, seen from the vehicle; coarser rings keep stale cells within finer ones."""
    x, y = (L.centre(F.col(i), F.col("ring"), s) - e for i, e in zip(("ix", "iy"), ego, strict=True))
    at = cells.select("*", F.inline(F.array(F.struct(x.alias("__x"), y.alias("__y")))))
    found = at.select("*", F.explode(F.array(L.ring_of(F.col("__x"), F.col("__y"), s))).alias("__ring"))
    return found.where(F.col("__ring") == F.col("ring")).drop("__x", "__y", "__ring")


def compared(cells: DataFrame, ref: DataFrame, s: Schedule = C.FOVEATED, ego: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Served cells that the map measured within the height band and the reference observed, with the error in cm."""
    mine = served(cells, s, ego).where((F.col("obs_count") > 0) & (F.col("var_code") > 0) & (F.col("ground_cm") > C.Z_MIN_CM) & (F.col("ground_cm") < C.Z_MAX_CM))
    return mine.join(ring_blocks(ref, s), CELL).withColumn("d", F.col("ground_cm") - F.col("ref_mean"))


def height_errors(both: DataFrame) -> DataFrame:
    """Per ring: rmse_cm, and over blocks of several fine cells the information loss, bias, spread and their ratio rho; cov, the median share of a block that was observed."""
    d, several = F.col("d"), F.col("n_ref") > 1
    root = lambda x: F.sqrt(F.avg(x))
    only = lambda x: F.when(several, x)
    out = both.groupBy("ring").agg(
        root(d * d).alias("rmse_cm"), root(only(d * d + F.col("ref_var"))).alias("il_cm"), root(only(d * d)).alias("bias_cm"), F.avg(only(d)).alias("mean_bias_cm"),
        F.avg(only((d > 0).cast("double"))).alias("above_frac"), root(only(F.col("ref_var"))).alias("spread_cm"), F.count_if(several).alias("n"), F.median("share").alias("cov"),
    )
    return out.withColumn("rho", F.when(F.col("spread_cm") > 1e-9, F.col("il_cm") / F.col("spread_cm")))


def with_share(both: DataFrame, s: Schedule = C.FOVEATED) -> DataFrame:
    k = L.by_ring(F.col("ring"), [r.units for r in s.bands])
    return both.withColumn("share", F.col("n_ref") / (k * k))


def occupancy_scores(cells: DataFrame, ref: DataFrame, s: Schedule = C.FOVEATED, ego: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Per ring: iou of occupied against observed cells, and fill, the share of reference cells that the map has seen."""
    truth = served(ring_blocks(ref, s).select(*CELL, F.lit(True).alias("truth")), s, ego)
    mine = served(cells, s, ego).select(*CELL, (M.occupancy(F.col("obs_count"), F.col("log_odds"), F.col("flags")) == C.OCCUPIED).alias("occupied"), (F.col("obs_count") > 0).alias("seen"))
    both = truth.join(mine, CELL, "full_outer").na.fill(False, ["truth", "occupied", "seen"])
    yes = lambda c: F.count_if(c)
    return both.groupBy("ring").agg(
        (yes(F.col("truth") & F.col("occupied")) / F.nullif(yes(F.col("truth") | F.col("occupied")), F.lit(0))).alias("iou"),
        (yes(F.col("truth") & F.col("seen")) / F.nullif(yes(F.col("truth")), F.lit(0))).alias("fill"),
    )


def saturated(cells: DataFrame, s: Schedule = C.FOVEATED, ego: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Per ring: share of seen cells whose height stands at the band's end."""
    g = F.col("ground_cm")
    return served(cells, s, ego).where("obs_count > 0").groupBy("ring").agg(F.avg(((g <= C.Z_MIN_CM) | (g >= C.Z_MAX_CM)).cast("double")).alias("saturated"))


def evaluate(cells: DataFrame, ref: DataFrame, s: Schedule = C.FOVEATED, ego: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """One row a ring with all scores, seen from the vehicle; rings without cells have nulls."""
    rings = cells.sparkSession.createDataFrame([(b.number, float(b.cell_m)) for b in s.bands], "ring int, cell_m double")
    scores = height_errors(with_share(compared(cells, ref, s, ego), s))
    return rings.join(scores, "ring", "left").join(occupancy_scores(cells, ref, s, ego), "ring", "left").join(saturated(cells, s, ego), "ring", "left")


def save_reference(ref: DataFrame, path: str, cell_m: float = 0.05) -> None:
    """The map as Parquet, with the size of its cells beside it."""
    ref.write.parquet(f"{path}/cells")
    ref.sparkSession.createDataFrame([(float(cell_m),)], "cell_m double").coalesce(1).write.parquet(f"{path}/lattice")


def load_reference(spark, path: str) -> tuple[DataFrame, float]:
    """A saved map and the size of its cells."""
    return spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/lattice").first().cell_m


def dynamic_removal(removed: Column, dynamic: Column, preserved: Column, static: Column) -> Column:
    """struct<DR, SP, F>: shares of dynamic cells removed and static ones kept, and their harmonic mean."""
    dr, sp = removed / F.nullif(dynamic, F.lit(0)), preserved / F.nullif(static, F.lit(0))
    return F.struct(dr.alias("DR"), sp.alias("SP"), F.when(dr + sp > 0, 2 * dr * sp / (dr + sp)).otherwise(0.0).alias("F"))
