"""One query for each operator, on the supplied tables, with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace import config as C
from terrace.config import FOVEATED
from terrace.functions import lattice as L
from terrace.functions import measure as M
from terrace.functions import sphere as S
from terrace.operators import fold, live, memory, perception, planning, pyramid, query, reference, refine, scatter, stencil, tracks
from terrace.operators.scatter import CELL
from terrace.plans import inputs as I
from terrace.plans import sql as Q
from terrace.sources import kitti, synthetic
from terrace.sources.tables import read, sweep_points, wide_points
from terrace.streaming.frames import windowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXPECTED: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            EXPECTED[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


def scaled(c, unit):
    """In units and rounded, off the ties that decimal inputs give, which engines round differently."""
    return F.rint(c * unit + 0.123)


# --- sources and projections -------------------------------------------------------


@register(f"WITH {Q.WIDE_SQL} SELECT frame, point_id, round_even(((-2e-2) * y2 * y2 / 3e0 + CASE WHEN abs(yw) > 3 THEN 0.12::DOUBLE ELSE 0e0 END + CASE WHEN xw > 30 THEN 6e-2 * (xw - 30) ELSE 0e0 END + CASE WHEN abs(yw) > 4 THEN 2e-2 * sin(12.7::DOUBLE * xw) * cos(11.3::DOUBLE * yw) ELSE 0e0 END - CASE WHEN sqrt((xw - 18) * (xw - 18) + yw * yw) < 0.3::DOUBLE THEN 0.4::DOUBLE ELSE 0e0 END) * 1e5 + 0.123::DOUBLE, 0) AS height_e5, CASE WHEN abs(yw) <= 3 THEN 40 WHEN abs(yw) <= 4 THEN 48 ELSE 44 END AS raw FROM (SELECT *, least(abs(yw), 3e0) AS y2 FROM wide)")
def s13_terrain(spark, sf_dir):
    p = wide_points(spark, sf_dir)
    return p.select("frame", "point_id", scaled(synthetic.terrain_height(F.col("xw"), F.col("yw")), 1e5).alias("height_e5"), synthetic.class_at(F.col("yw")).alias("raw"))


@register()
def s14_beam_scan(spark, sf_dir):
    return synthetic.scan(spark, frames=2, beams=32, azimuths=180)


@register(f"WITH {Q.WIDE_SQL} SELECT frame, point_id, {Q.fd('xw')} AS i, {Q.fd('yw')} AS j, floor({Q.fd('xw')} / 8)::BIGINT AS i3 FROM wide")
def p5_base_lattice(spark, sf_dir):
    i = L.floor_div(F.col("xw"), 0.05)
    return wide_points(spark, sf_dir).select("frame", "point_id", i.alias("i"), L.floor_div(F.col("yw"), 0.05).alias("j"), L.idiv(i, 8).alias("i3"))


@register(f"WITH {Q.WIDE_SQL} SELECT frame, point_id, round({Q.d_aniso('x', 'y', 'speed')}, 9) AS d FROM wide")
def p8_stretched_distance(spark, sf_dir):
    return wide_points(spark, sf_dir).select("frame", "point_id", F.round(L.d_aniso(F.col("x"), F.col("y"), FOVEATED, F.col("speed")), 9).alias("d"))


@register(f"WITH {Q.WIDE_SQL} SELECT frame, point_id, {Q.ring('x', 'y')} AS still, {Q.ring('x', 'y', 'speed')} AS moving FROM wide")
def p9_ring_of(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    return wide_points(spark, sf_dir).select("frame", "point_id", L.ring_of(x, y, FOVEATED).alias("still"), L.ring_of(x, y, FOVEATED, F.col("speed")).alias("moving"))


@register(f"WITH {Q.WIDE_SQL}, t AS (SELECT *, (l % 5) - 1 AS cur, {Q.ring('x', 'y')} AS target, {Q.d_aniso('x', 'y', '0e0')} AS d FROM (SELECT *, point_id % 1009 AS l FROM wide)) SELECT frame, point_id, CASE WHEN cur = -1 THEN target WHEN d > [10, 25, 50, 100][cur + 1] * (1e0 + 1e-1) THEN CASE WHEN target = -1 THEN -1 ELSE greatest(target, cur + 1) END WHEN cur > 0 AND d < [0, 10, 25, 50][cur + 1] THEN target ELSE cur END AS ring FROM t")
def p11_hysteresis(spark, sf_dir):
    cur = ((F.col("point_id") % 1009 % 5) - 1).cast("int")
    return wide_points(spark, sf_dir).select("frame", "point_id", L.migrate_ring(F.col("x"), F.col("y"), FOVEATED, cur).alias("ring"))


_WINDOW = f"floor({{e}} / {Q.SIZE})::BIGINT - {Q.SIDE} // 2"


@register(f"WITH {Q.WIDE_BINNED}, w AS (SELECT *, {_WINDOW.format(e='(2e0 * frame)')} AS x0, -({Q.SIDE} // 2) AS y0 FROM wb) SELECT frame, point_id, ring, ix, iy, ({Q.OFFSET} + ((iy % {Q.SIDE} + {Q.SIDE}) % {Q.SIDE}) * {Q.SIDE} + ((ix % {Q.SIDE} + {Q.SIDE}) % {Q.SIDE}))::BIGINT AS slot FROM w WHERE ix >= x0 AND ix < x0 + {Q.SIDE} AND iy >= y0 AND iy < y0 + {Q.SIDE}")
def p12_binning(spark, sf_dir):
    at = scatter.binned(wide_points(spark, sf_dir), FOVEATED, "xw", "yw", F.col("speed"), (2.0 * F.col("frame"), F.lit(0.0)))
    return at.select("frame", "point_id", *CELL, L.slot(F.col("ix"), F.col("iy"), F.col("ring"), FOVEATED).alias("slot"))


@register("SELECT i, j, CASE WHEN i NOT BETWEEN 0 AND 19 OR j NOT BETWEEN 0 AND 19 THEN -1 WHEN j < 6 THEN j * 20 + i WHEN j >= 14 THEN 120 + (j - 14) * 20 + i WHEN i < 6 THEN 240 + (j - 6) * 6 + i WHEN i >= 14 THEN 288 + (j - 6) * 6 + (i - 14) ELSE -1 END::BIGINT AS slot FROM (SELECT DISTINCT p_partkey % 23 - 1 AS i, p_size % 23 - 1 AS j FROM part)")
def p16_annulus(spark, sf_dir):
    at = read(spark, sf_dir, "part").select((F.col("p_partkey") % 23 - 1).alias("i"), (F.col("p_size") % 23 - 1).alias("j")).distinct()
    return at.select("i", "j", L.annulus_index(F.col("i"), F.col("j"), 20, 6, 14).alias("slot"))


@register(f"WITH {Q.PTS_SQL} SELECT frame, point_id, round({Q.variance()}, 9) AS variance, {Q.weight(Q.variance())} AS w, {Q.height('z')} AS z_cm FROM (SELECT *, {Q.R} AS r FROM pts)")
def p18_measurement(spark, sf_dir):
    v = M.variance_cm2(S.range_m(F.col("x"), F.col("y"), F.col("z")))
    return sweep_points(spark, sf_dir).select("frame", "point_id", F.round(v, 9).alias("variance"), M.weight(v).alias("w"), M.height_cm(F.col("z")).alias("z_cm"))


@register(f"SELECT code, round({Q.decode('code')}, 6) AS variance, {Q.encode(Q.decode('code') + ' * 1.01::DOUBLE')} AS again FROM (SELECT DISTINCT (o_orderkey % 256)::INT AS code FROM orders)")
def p21_variance_code(spark, sf_dir):
    code = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 256).cast("int").alias("code")).distinct()
    return code.select("code", r6(M.decode_variance(F.col("code"))).alias("variance"), M.encode_variance(M.decode_variance(F.col("code")) * 1.01).alias("again"))


@register("SELECT DISTINCT c, n, ((c << 3) | n)::INT AS packed, (((c << 3) | n) >> 3)::INT AS candidate, (((c << 3) | n) & 7)::INT AS counter FROM (SELECT (l_suppkey % 32)::INT AS c, (l_partkey % 8)::INT AS n FROM lineitem)")
def p22_class_byte(spark, sf_dir):
    at = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 32).cast("int").alias("c"), (F.col("l_partkey") % 8).cast("int").alias("n")).distinct()
    packed = at.withColumn("packed", M.pack_class(F.col("c"), F.col("n")))
    return packed.withColumns({"candidate": M.candidate(F.col("packed")), "counter": M.counter(F.col("packed"))})


@register(f"WITH {Q.PTS_SQL} SELECT raw_label, cls AS live, moving, ground, count(*)::BIGINT AS n FROM pts GROUP BY ALL")
def p23_labels(spark, sf_dir):
    return sweep_points(spark, sf_dir).groupBy("raw_label", F.col("cls").alias("live"), "moving", "ground").agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {Q.PTS_SQL} SELECT frame, point_id, {Q.PIX} AS u, {Q.elevation('z', 'r')} AS v FROM (SELECT *, {Q.R} AS r FROM pts)")
def p26_pixels(spark, sf_dir):
    return perception.with_pixels(sweep_points(spark, sf_dir)).select("frame", "point_id", "u", F.col("v_raw").alias("v"))


@register(f"WITH {Q.PTS_SQL} SELECT frame, point_id, round(greatest(3e0 * sqrt(r * r * {Q.num(C.THRESHOLDS.sigma_phi_rad ** 2)} + (1.73::DOUBLE / greatest(r, 1e-3)) * (1.73::DOUBLE / greatest(r, 1e-3)) * 0.0004::DOUBLE), 0.3::DOUBLE), 9) AS tolerance FROM (SELECT *, {Q.R} AS r FROM pts)")
def p29_clear_tolerance(spark, sf_dir):
    return sweep_points(spark, sf_dir).select("frame", "point_id", F.round(M.clear_tolerance(S.range_m(F.col("x"), F.col("y"), F.col("z"))), 9).alias("tolerance"))


@register("SELECT DISTINCT q, t, CASE WHEN c < p THEN round(q * 1e-2 + 6.25e-2 * (t * 1e-2) * (t * 1e-2) * (p * p - c * c) + 0e0, 9) END AS variance FROM (SELECT l_quantity AS q, l_linenumber AS t, 2e-1 AS p, (l_linenumber % 3 + 1) * 1e-1 AS c FROM lineitem)")
def p31_inflate(spark, sf_dir):
    q, t = F.col("l_quantity"), F.col("l_linenumber")
    rows = read(spark, sf_dir, "lineitem").select(q.alias("q"), t.alias("t"), F.round(M.inflate(q * 0.01, t * 0.01, F.lit(0.2), (t % 3 + 1) * 0.1), 9).alias("variance"))
    return rows.distinct()


@register(f"WITH {Q.WIDE_SQL} SELECT frame, point_id, round(1e0 / (1e0 + r / 10) * CASE WHEN moving THEN 4e0 ELSE 1e0 END * greatest(1e0 / (1e0 + t / 3e0), 5e-2), 9) AS score, CASE WHEN isinf(t) THEN NULL ELSE round(t, 9) END AS ttc FROM (SELECT *, sqrt(x * x + y * y) AS r, CASE WHEN x > 0 THEN x / speed ELSE 'inf'::DOUBLE END AS t FROM wide)")
def p32_priority(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    ttc = M.time_to_collision(x, F.col("speed"))
    score = M.priority(F.sqrt(x * x + y * y), F.col("moving"), ttc)
    return wide_points(spark, sf_dir).select("frame", "point_id", F.round(score, 9).alias("score"), F.when(ttc < float("inf"), F.round(ttc, 9)).alias("ttc"))


@register(f"WITH {I.COST_SQL} SELECT \"window\", map_id, i, j, trav, unknown, CASE WHEN isinf(cost) THEN NULL ELSE cost END AS cost FROM cm")
def p34_costs(spark, sf_dir):
    return I.cost_maps(spark, sf_dir).withColumn("cost", F.when(F.col("cost") < float("inf"), F.col("cost")))


@register("SELECT DISTINCT r, round(r * (2e-1 * pi() / 180), 9) AS s_az, round(r * r * (26.9::DOUBLE / 63 * pi() / 180) / 1.73::DOUBLE, 9) AS s_rad, round(least(1e0, 5e-2 / (r * r * (26.9::DOUBLE / 63 * pi() / 180) / 1.73::DOUBLE)) * least(1e0, 5e-2 / (r * (2e-1 * pi() / 180))), 9) AS fill FROM (SELECT l_quantity * 2 AS r FROM lineitem)")
def p35_sampling(spark, sf_dir):
    r = F.col("r")
    return read(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 2).alias("r")).distinct().select("r", F.round(M.azimuth_spacing(r), 9).alias("s_az"), F.round(M.radial_spacing(r), 9).alias("s_rad"), F.round(M.fill_probability(r, F.lit(0.05)), 9).alias("fill"))


# --- scatter and reductions ----------------------------------------------------------


@register(f"WITH {Q.BINNED}, a AS ({Q.AGG} FROM b GROUP BY frame, ring, ix, iy) SELECT *, {Q.mean('wz_sum', 'w_sum')} AS mean_cm, w_sum > 0 AS has_ground FROM a")
def a1_scatter(spark, sf_dir):
    return scatter.frame_cells(sweep_points(spark, sf_dir))


@register(f"WITH {Q.PTS_SQL}, {Q.IMAGE} SELECT frame, v, u, round(r, 9) AS r, point_id FROM im")
def a6_range_image(spark, sf_dir):
    return perception.range_image(sweep_points(spark, sf_dir)).select("frame", "v", "u", F.round("r", 9).alias("r"), "point_id")


@register(f"WITH {Q.PTS_SQL}, {Q.IMAGE} SELECT frame, count(*)::BIGINT AS n_input, count(*) FILTER (r <= 1e-6)::BIGINT AS n_zero_range, count(*) FILTER (r > 1e-6 AND v_raw < 0)::BIGINT AS n_clamped_above, count(*) FILTER (r > 1e-6 AND v_raw >= 64)::BIGINT AS n_clamped_below, count(DISTINCT least(greatest(v_raw, 0), 63) * 512 + u)::BIGINT AS n_pixels FROM px GROUP BY frame")
def a7_projection_stats(spark, sf_dir):
    return perception.projection_stats(sweep_points(spark, sf_dir)).drop("fill", "out_of_view")


@register(f"WITH {Q.BINNED} SELECT frame, ring, ix, iy, greatest(max(z_cm), 0)::INT AS ground_cm, 8 AS flags FROM b WHERE moving GROUP BY ALL")
def a8_transient(spark, sf_dir):
    return scatter.transient_cells(sweep_points(spark, sf_dir))


@register(f"WITH {Q.PTS_SQL} SELECT frame, floor(x)::BIGINT AS cx, floor(y)::BIGINT AS cy, round(avg(x), 6) AS x, round(avg(y), 6) AS y, max(z) AS z_max, (min({{'p': point_id, 'c': cls}})).c AS class_id, count(*)::BIGINT AS n FROM pts WHERE moving GROUP BY frame, floor(x), floor(y)")
def a9_clusters(spark, sf_dir):
    return scatter.clusters(sweep_points(spark, sf_dir)).withColumns({"x": r6(F.col("x")), "y": r6(F.col("y"))})


_CHILDREN = """ch AS (SELECT p_partkey // 4 AS parent, p_size * 1e-2 AS mu, (p_partkey % 7 + 1) * 1e-3 AS s2, (p_partkey % 5)::BIGINT AS n, (p_size % 16)::INT AS flags,
  CASE WHEN (p_partkey // 4) % 3 = 0 THEN p_partkey // 4 END AS pid, (p_partkey // 4 % 5)::BIGINT AS pn FROM part)"""


def _children(spark, sf_dir):
    p, s = F.col("p_partkey"), F.col("p_size")
    parent = F.floor(p / 4).cast("bigint")
    derived = parent % 3 == 0
    return read(spark, sf_dir, "part").select(
        parent.alias("parent"), (s * 0.01).alias("mu_m"), ((p % 7 + 1) * 0.001).alias("sigma2_m2"), F.when(derived, parent % 5).otherwise(p % 5).alias("n"),
        F.when(derived, s.bitwiseOR(1) % 16).otherwise(s % 16).cast("int").alias("flags"), F.when(derived, parent).alias("parent_id"), F.lit(0.5).alias("parent_mu_m"), F.lit(0.002).alias("parent_sigma2_m2"), (parent % 5).alias("parent_n"),
    )


@register("""WITH ch AS (SELECT p_partkey // 4 AS parent, p_size * 1e-2 AS mu, (p_partkey % 7 + 1) * 1e-3 AS s2, (CASE WHEN p_partkey // 4 % 3 = 0 THEN p_partkey // 4 % 5 ELSE p_partkey % 5 END)::BIGINT AS n,
    (CASE WHEN p_partkey // 4 % 3 = 0 THEN (p_size | 1) % 16 ELSE p_size % 16 END)::INT AS flags FROM part),
t AS (SELECT parent, sum(n) AS tot, count(*) AS m FROM ch GROUP BY parent), w AS (SELECT ch.*, CASE WHEN tot > 0 THEN n::DOUBLE / tot ELSE 1e0 / m END AS w FROM ch JOIN t USING (parent)),
mm AS (SELECT parent, sum(w * mu) AS mean FROM w GROUP BY parent)
SELECT parent, round(CASE WHEN parent % 3 = 0 THEN 5e-1 ELSE any_value(mean) END, 9) AS mu_m, round(CASE WHEN parent % 3 = 0 THEN 2e-3 ELSE sum(w * s2) + sum(w * (mu - mean) * (mu - mean)) END, 9) AS sigma2_m2,
  min(n)::BIGINT AS n, ((bit_and(flags) & 5) | (bit_or(flags) & 8))::INT AS flags, parent % 3 = 0 AS restored FROM w JOIN mm USING (parent) GROUP BY parent""")
def a10_merge(spark, sf_dir):
    return refine.merged(_children(spark, sf_dir), ["parent"]).withColumns({"mu_m": F.round("mu_m", 9), "sigma2_m2": F.round("sigma2_m2", 9)})


_NODES = f"nd AS (SELECT ring, l AS level, (iy + 250) >> l AS row, (ix + 250) >> l AS col, max(ground_cm) AS h_max, min(ground_cm) AS h_min, min(ceiling_cm) AS c_min, min(obs_count) AS n_min, bit_and(trav) AS and_mask, bit_or(trav) AS or_mask, count(*)::BIGINT AS cells FROM tr, range(1, 10) r(l) GROUP BY ALL)"


@register(f"WITH {Q.RASTER_TRAV}, {_NODES} SELECT * FROM nd")
def a11_pyramid(spark, sf_dir):
    return pyramid.nodes(I.raster_trav(spark, sf_dir))


@register(f"WITH {Q.RASTER_TRAV}, {_NODES}, x AS (SELECT *, cells < (least((row + 1) << level, 500) - (row << level)) * (least((col + 1) << level, 500) - (col << level)) AS unseen FROM nd) SELECT level, CASE WHEN (CASE WHEN unseen THEN or_mask | 56 ELSE or_mask END) = 0 THEN 0 WHEN (CASE WHEN unseen THEN and_mask & 56 ELSE and_mask END) <> 0 THEN 1 ELSE 2 END AS state, count(*)::BIGINT AS n FROM x GROUP BY ALL")
def a12_classify(spark, sf_dir):
    return pyramid.classified(pyramid.nodes(I.raster_trav(spark, sf_dir))).groupBy("level", "state").agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {Q.PTS_SQL}, {Q.MSTAR} SELECT i, j, round(height_cm, 6) AS height_cm, count::BIGINT AS count, class_id FROM ms")
def a13_reference_map(spark, sf_dir):
    return reference.reference_map(sweep_points(spark, sf_dir)).withColumn("height_cm", r6(F.col("height_cm")))


@register(f"WITH {Q.PTS_SQL}, {Q.MSTAR}, {Q.BLOCKS} SELECT ring, ix, iy, n_ref, round_even(ref_mean * 1e3 + 0.123::DOUBLE, 0) AS mean_e3, round_even(ref_var * 1e2 + 0.123::DOUBLE, 0) AS var_e2 FROM bl")
def a14_block_stats(spark, sf_dir):
    return reference.ring_blocks(reference.reference_map(sweep_points(spark, sf_dir))).select(*CELL, "n_ref", scaled(F.col("ref_mean"), 1e3).alias("mean_e3"), scaled(F.col("ref_var"), 1e2).alias("var_e2"))


@register(f"WITH {Q.PTS_SQL}, {Q.MSTAR}, v AS (SELECT floor(i / 4)::BIGINT AS bi, floor(j / 4)::BIGINT AS bj, class_id, count(*) AS c FROM ms GROUP BY ALL) SELECT bi, bj, class_id FROM v QUALIFY row_number() OVER (PARTITION BY bi, bj ORDER BY c DESC, class_id) = 1")
def a15_block_class(spark, sf_dir):
    return reference.block_class(reference.reference_map(sweep_points(spark, sf_dir)), 4)


@register()
def a16_costs_of_map(spark, sf_dir):
    return planning.cost_map_of_cells(I.raster_trav(spark, sf_dir), 12.0, -1.0, 12, 12, FOVEATED).unionByName(planning.cost_map_of_cells(stencil.traversability(I.state(spark, sf_dir)), -1.0, -1.0, 8, 8))


@register()
def a17_costs_of_reference(spark, sf_dir):
    return planning.cost_map_of_reference(reference.reference_map(sweep_points(spark, sf_dir)), -1.0, -1.0, 8, 8)


@register(f"""WITH RECURSIVE {Q.PATCHY}, ed AS (SELECT a.frame, a.v * 512 + a.u AS p, b.v * 512 + b.u AS q FROM pi a JOIN pi b ON a.frame = b.frame AND abs(a.r - b.r) <= 0.75::DOUBLE AND ((b.v = a.v AND b.u = (a.u + 1) % 512) OR (b.v = a.v + 1 AND b.u = a.u))),
e2 AS (SELECT * FROM ed UNION SELECT frame, q, p FROM ed), rc AS (SELECT frame, v * 512 + u AS p, v * 512 + u AS root FROM pi UNION SELECT rc.frame, e2.q, rc.root FROM rc JOIN e2 ON e2.frame = rc.frame AND e2.p = rc.p WHERE rc.root <= e2.q),
lb AS (SELECT frame, p, min(root) AS instance FROM rc GROUP BY frame, p), g AS (SELECT frame, instance::BIGINT AS instance, count(*)::BIGINT AS n, round(avg(r), 6) AS x_mean, min(r) AS x_min, max(r) AS x_max, round(avg(u), 6) AS y_mean, min(u)::DOUBLE AS y_min, max(u)::DOUBLE AS y_max,
  round(avg(v), 6) AS z_mean, min(v)::DOUBLE AS z_min, max(v)::DOUBLE AS z_max FROM lb JOIN pi USING (frame) WHERE pi.v * 512 + pi.u = lb.p GROUP BY frame, instance HAVING count(*) >= 4)
SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n DESC, instance)::INT AS rank FROM g""")
def a18_instances(spark, sf_dir):
    return perception.instances(I.patchy_image(spark, sf_dir)).withColumns({f"{c}_mean": r6(F.col(f"{c}_mean")) for c in "xyz"})


@register(f"WITH {Q.PTS_SQL} SELECT floor(x / 5e-2)::BIGINT AS ix, floor(y / 5e-2)::BIGINT AS iy, least(count(*), 255)::BIGINT AS n, (max({{'f': frame, 'p': point_id, 'z': z}})).z AS z FROM pts GROUP BY ALL")
def a19_uniform_grid(spark, sf_dir):
    return scatter.uniform_baseline(sweep_points(spark, sf_dir))


@register(f"WITH {Q.PTS_SQL} SELECT iz, count(*)::BIGINT AS n FROM (SELECT DISTINCT floor(x / 5e-2) AS ix, floor(y / 5e-2) AS iy, floor((z + 2e0) / 5e-2)::BIGINT AS iz FROM pts) WHERE iz BETWEEN 0 AND 159 GROUP BY iz")
def a19_dense_voxels(spark, sf_dir):
    return scatter.dense_voxels(sweep_points(spark, sf_dir)).groupBy("iz").agg(F.count(F.lit(1)).alias("n"))


@register("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, min(value) FILTER (k = ceil(5e-1 * (n - 1)) + 1) AS p50, min(value) FILTER (k = ceil(0.99::DOUBLE * (n - 1)) + 1) AS p99, max(value) AS max, round(100e0 / min(value) FILTER (k = ceil(5e-1 * (n - 1)) + 1), 6) AS headroom FROM r GROUP BY event_type")
def a20_latency(spark, sf_dir):
    return memory.latency(read(spark, sf_dir, "events"), "event_type", "value").withColumn("headroom", r6(F.col("headroom")))


@register(f"WITH {Q.RASTER_TRAV} SELECT ring, count(*)::BIGINT AS n, {', '.join(f'count(*) FILTER (trav & {1 << b} <> 0)::BIGINT AS bit{b}' for b in range(6))} FROM tr GROUP BY ring")
def a26_bit_counts(spark, sf_dir):
    return I.raster_trav(spark, sf_dir).groupBy("ring").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("trav").bitwiseAND(1 << b) != 0).alias(f"bit{b}") for b in range(6)))


@register("WITH c AS (SELECT label % 5 AS truth, (label * 3 + vec_id) % 5 AS guess FROM embeddings), k AS (SELECT DISTINCT truth AS k FROM c UNION SELECT DISTINCT guess FROM c) SELECT k::BIGINT AS cls, count(*) FILTER (truth = k AND guess = k)::BIGINT AS hit, count(*) FILTER (truth = k OR guess = k)::BIGINT AS either, round(count(*) FILTER (truth = k AND guess = k) / count(*) FILTER (truth = k OR guess = k), 9) AS iou FROM c, k GROUP BY k")
def a24_segmentation_iou(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select((F.col("label") % 5).cast("bigint").alias("truth"), ((F.col("label") * 3 + F.col("vec_id")) % 5).alias("guess"))
    hit = (F.col("truth") == F.col("guess")).cast("bigint")
    long = e.select(F.explode(F.when(hit == 1, F.array(F.struct(F.col("truth").alias("cls"), hit.alias("hit")))).otherwise(F.array(F.struct(F.col("truth").alias("cls"), hit.alias("hit")), F.struct(F.col("guess").alias("cls"), hit.alias("hit"))))).alias("x"))
    return long.groupBy("x.cls").agg(F.sum("x.hit").alias("hit"), F.count(F.lit(1)).alias("either")).withColumn("iou", F.round(F.col("hit") / F.col("either"), 9))


@register("SELECT label, k::INT - 1 AS channel, max(embedding[k]) AS top, round(avg(embedding[k]::DOUBLE), 6) AS mean FROM embeddings, range(1, 65) r(k) GROUP BY label, k")
def l2_segment_reductions(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("channel", "v")).groupBy("label", "channel").agg(F.max("v").alias("top"), r6(F.avg(F.col("v").cast("double"))).alias("mean"))


# --- stencils ------------------------------------------------------------------------


@register(f"WITH {Q.RASTER}, {Q.SLOPES} SELECT ring, ix, iy, round(dzdx, 9) AS dzdx, round(dzdy, 9) AS dzdy, step_cm, all_seen FROM sl")
def w1_gradient_step(spark, sf_dir):
    return stencil.with_slopes(I.raster(spark, sf_dir)).select(*CELL, F.round("dzdx", 9).alias("dzdx"), F.round("dzdy", 9).alias("dzdy"), "step_cm", "all_seen")


@register(f"WITH {Q.RASTER_TRAV} SELECT ring, ix, iy, trav FROM tr")
def w4_traversability(spark, sf_dir):
    return I.raster_trav(spark, sf_dir).select(*CELL, "trav")


_CURB = f"""ne AS (SELECT t.ring, t.ix, t.iy, (e.ground_cm - w.ground_cm)::DOUBLE AS dx, (n.ground_cm - s.ground_cm)::DOUBLE AS dy FROM ras t {Q.neighbours("ras", 1, None)} WHERE e.ring IS NOT NULL AND w.ring IS NOT NULL AND n.ring IS NOT NULL AND s.ring IS NOT NULL),
bd AS (SELECT *, sqrt(dx * dx + dy * dy) AS rise, ((round_even(atan2(dy, dx) / (pi() / 4), 0)::INT % 8) + 8) % 8 AS oct FROM ne WHERE sqrt(dx * dx + dy * dy) BETWEEN 5 AND 25),
dr AS (SELECT *, [1, 1, 0, -1, -1, -1, 0, 1][(oct + 2) % 8 + 1] AS ddx, [0, 1, 1, 1, 0, -1, -1, -1][(oct + 2) % 8 + 1] AS ddy FROM bd),
cu AS (SELECT d.ring, d.ix, d.iy, d.rise AS rise_cm, d.oct AS octant FROM dr d JOIN dr f ON f.ix = d.ix + d.ddx AND f.iy = d.iy + d.ddy JOIN dr b ON b.ix = d.ix - d.ddx AND b.iy = d.iy - d.ddy
  WHERE abs((((f.oct - d.oct + 4) % 8) + 8) % 8 - 4) <= 1 AND abs((((b.oct - d.oct + 4) % 8) + 8) % 8 - 4) <= 1)"""


@register(f"WITH {Q.RASTER}, {_CURB} SELECT ring, ix, iy, round(rise_cm, 6) AS rise_cm, octant FROM cu")
def w5_curbs(spark, sf_dir):
    return stencil.curbs(I.raster(spark, sf_dir)).withColumn("rise_cm", r6(F.col("rise_cm")))


_HOLE = """ax AS (SELECT t.ring, t.ix, t.iy, t.ground_cm, a.ground_cm::DOUBLE AS p, b.ground_cm::DOUBLE AS q FROM ras t, (VALUES (1, 0), (1, 1), (0, 1), (-1, 1)) v(dx, dy)
  JOIN ras a ON a.ix = t.ix - 8 * dx AND a.iy = t.iy - 8 * dy JOIN ras b ON b.ix = t.ix + 8 * dx AND b.iy = t.iy + 8 * dy),
rm AS (SELECT ring, ix, iy, any_value(ground_cm) AS g, count(*) AS pairs, flatten(list([p, q])) AS rim FROM ax GROUP BY ring, ix, iy),
md AS (SELECT *, list_median(rim) AS med FROM rm),
ho AS (SELECT ring, ix, iy, med - g AS depth_cm, pairs::INT AS rim_pairs FROM md WHERE pairs >= 2 AND med - g BETWEEN 8 AND 50 AND list_max(rim) - list_min(rim) <= 8 AND len(list_filter(rim, lambda x: med - x > 4)) <= 5e-1 * pairs)"""


@register(f"WITH {Q.RASTER}, {_HOLE} SELECT * FROM ho")
def w5b_potholes(spark, sf_dir):
    return stencil.potholes(I.raster(spark, sf_dir))


@register(f"WITH {Q.RASTER}, {_CURB}, {_HOLE}, f AS (SELECT 'curb' AS kind, ring, rise_cm AS v FROM cu UNION ALL SELECT 'pothole', ring, depth_cm FROM ho) SELECT kind, ring, count(*)::BIGINT AS n, round(quantile_cont(v, 1e-1), 6) AS p10, round(quantile_cont(v, 5e-1), 6) AS median, round(quantile_cont(v, 9e-1), 6) AS p90 FROM f GROUP BY ALL")
def a22_feature_summary(spark, sf_dir):
    found = stencil.feature_summary(stencil.features(I.raster(spark, sf_dir)))
    return found.withColumns({c: r6(F.col(c)) for c in ("p10", "median", "p90")})


_CONF = f"""cf AS (SELECT *, CASE WHEN NOT drivable THEN 0e0 ELSE least(label, evidence, geometry, surface) END AS confidence,
  CASE WHEN NOT drivable THEN 'not-drivable' WHEN label = m THEN 'label' WHEN evidence = m THEN 'evidence' WHEN geometry = m THEN 'geometry' ELSE 'surface' END AS binding FROM (SELECT *, least(label, evidence, geometry, surface) AS m FROM (SELECT ring, ix, iy, obs_count,
  (class_byte >> 3) IN (8, 9, 10, 11, 16) AS drivable, least(greatest((obs_count + (class_byte & 7)) / (2e0 * obs_count), 0e0), 1e0) AS label, least(greatest(obs_count / 3e0, 0e0), 1e0) AS evidence,
  least(greatest(least(1e0 - sqrt(dzdx * dzdx + dzdy * dzdy) / {Q.num(C.THRESHOLDS.tan_slope)}, 1e0 - step_cm / 15e0), 0e0), 1e0) AS geometry, least(greatest(1e0 - {Q.decode("var_code")} / 25e0, 0e0), 1e0) AS surface FROM sl)))"""


@register(f"WITH {Q.RASTER}, {Q.SLOPES}, {_CONF} SELECT ring, ix, iy, {', '.join(f'round({c}, 9) AS {c}' for c in ('label', 'evidence', 'geometry', 'surface', 'confidence'))}, binding FROM cf")
def w7_confidence(spark, sf_dir):
    return stencil.confidence(I.raster(spark, sf_dir)).select(*CELL, *(F.round(c, 9).alias(c) for c in ("label", "evidence", "geometry", "surface", "confidence")), "binding")


@register(f"WITH {Q.RASTER}, {Q.SLOPES}, {_CONF} SELECT ring, count(*)::BIGINT AS n, round(avg(confidence), 6) AS mean, round(avg((confidence >= 0.8::DOUBLE)::INT), 6) AS high, round(avg((confidence < 0.2::DOUBLE)::INT), 6) AS low, (SELECT binding FROM cf c2 WHERE c2.ring = cf.ring GROUP BY binding ORDER BY count(*) DESC, list_position(['not-drivable', 'label', 'evidence', 'geometry', 'surface'], binding) LIMIT 1) AS binding FROM cf GROUP BY ring")
def a23_confidence_summary(spark, sf_dir):
    found = stencil.confidence_summary(stencil.confidence(I.raster(spark, sf_dir)))
    return found.withColumns({c: r6(F.col(c)) for c in ("mean", "high", "low")})


_COS = """nb AS (SELECT t.*, e.x - w.x AS ax, e.y - w.y AS ay, e.z - w.z AS az, h.x - l.x AS bx, h.y - l.y AS b_y, h.z - l.z AS bz FROM im t
  LEFT JOIN im e ON e.frame = t.frame AND e.v = t.v AND e.u = (t.u + 1) % 512 LEFT JOIN im w ON w.frame = t.frame AND w.v = t.v AND w.u = (t.u + 511) % 512
  LEFT JOIN im h ON h.frame = t.frame AND h.v = t.v + 1 AND h.u = t.u LEFT JOIN im l ON l.frame = t.frame AND l.v = t.v - 1 AND l.u = t.u),
nm AS (SELECT *, ay * bz - az * b_y AS nx, az * bx - ax * bz AS ny, ax * b_y - ay * bx AS nz FROM nb),
cs AS (SELECT *, CASE WHEN sqrt(nx * nx + ny * ny + nz * nz) > 1e-6 THEN abs(nx * x + ny * y + nz * z) / (sqrt(nx * nx + ny * ny + nz * nz) * r) END AS cos_inc FROM nm)"""


@register(f"WITH {Q.PTS_SQL}, {Q.IMAGE}, {_COS} SELECT frame, v, u, round(cos_inc, 6) AS cos_inc, least(greatest(round_even(intensity / 1e0 * 255e0, 0), 0e0), 255e0)::INT AS rho8, CASE WHEN cos_inc IS NULL THEN 2 WHEN cos_inc < 1e-1 THEN 1 ELSE 0 END AS flags FROM cs")
def w6_reflectivity(spark, sf_dir):
    return perception.reflectivity(perception.range_image(sweep_points(spark, sf_dir))).select("frame", "v", "u", r6(F.col("cos_inc")).alias("cos_inc"), "rho8", "flags")


@register(f"WITH {Q.PTS_SQL}, {Q.IMAGE} SELECT a.frame, a.v, a.u + 1 AS u, round((a.r + b.r) / 2, 9) AS r FROM im a JOIN im b ON a.frame = b.frame AND a.v = b.v AND b.u = a.u + 2 WHERE NOT EXISTS (SELECT 1 FROM im c WHERE c.frame = a.frame AND c.v = a.v AND c.u = a.u + 1)")
def w9_gap_filling(spark, sf_dir):
    return perception.filled_gaps(perception.range_image(sweep_points(spark, sf_dir))).select("frame", "v", "u", F.round("r", 9).alias("r"))


# --- state, visibility, motion ---------------------------------------------------------


@register(f"WITH {Q.FOLDED} SELECT * FROM st")
def t1_fold(spark, sf_dir):
    return I.state(spark, sf_dir)


@register(f"WITH {Q.FOLDED} SELECT ring, {Q.occupancy()} AS occupancy, count(*)::BIGINT AS n FROM st GROUP BY ALL")
def p36_occupancy(spark, sf_dir):
    return I.state(spark, sf_dir).groupBy("ring", M.occupancy(F.col("obs_count"), F.col("log_odds"), F.col("flags")).alias("occupancy")).agg(F.count(F.lit(1)).alias("n"))


def _windows(spark):
    return fold.windows_of(spark.range(7).select(F.col("id").cast("int").alias("frame"), (F.col("id") * 2.0).alias("ego_x"), F.lit(0.0).alias("ego_y")), FOVEATED)


_WIN = f"win AS (SELECT f::INT AS frame, ring, {_WINDOW.format(e='(2e0 * f)')} AS x0, (-({Q.SIDE} // 2))::BIGINT AS y0, {Q.SIDE} AS side FROM range(7) r(f), (VALUES (0), (1), (2), (3)) v(ring))"


@register(f"WITH {_WIN} SELECT b.frame, b.ring, (b.side * b.side - (b.side - least(abs(b.x0 - a.x0), b.side)) * b.side)::BIGINT AS cleared FROM win b JOIN win a ON a.frame = b.frame - 1 AND a.ring = b.ring")
def t8_shift_costs(spark, sf_dir):
    return fold.shift_costs(_windows(spark))


@register(f"WITH {Q.WIDE_BINNED.replace('{', '{')}, {_WIN}, k AS (SELECT DISTINCT frame, ring, ix, iy FROM wb), g AS (SELECT k.ring, ix, iy, coalesce(max(w.frame), -1) AS gone FROM (SELECT DISTINCT ring, ix, iy FROM k) k LEFT JOIN win w ON w.ring = k.ring AND NOT (ix BETWEEN x0 AND x0 + side - 1 AND iy BETWEEN y0 AND y0 + side - 1) GROUP BY k.ring, ix, iy) SELECT k.ring, k.frame, count(*)::BIGINT AS cells FROM k JOIN g USING (ring, ix, iy) WHERE k.frame > gone GROUP BY ALL")
def t7_evictions(spark, sf_dir):
    at = scatter.measured(scatter.binned(wide_points(spark, sf_dir), FOVEATED, "xw", "yw", F.col("speed")))
    return fold.last_islands(scatter.scatter(at, ["frame", *CELL]), _windows(spark)).groupBy("ring", "frame").agg(F.count(F.lit(1)).alias("cells"))


def _tested(spark, sf_dir):
    points = sweep_points(spark, sf_dir)
    there = perception.occupied_in_frame(I.state(spark, sf_dir).withColumn("frame", F.lit(6)), F.lit(0.0), F.lit(0.0))
    touched = scatter.binned(points.where("frame = 6"), FOVEATED).select("frame", *CELL)
    return perception.seen_through(there, perception.range_image(points.where("frame = 6")), touched)


_THROUGH = f"""{Q.FOLDED}, {Q.IMAGE}, oc AS (SELECT *, (ix + 5e-1) * {Q.SIZE} AS x, (iy + 5e-1) * {Q.SIZE} AS y, (CASE WHEN ceiling_cm <> 32767 THEN ceiling_cm ELSE ground_cm END) / 1e2 - 1.73::DOUBLE AS z FROM st WHERE {Q.occupancy()} = 2),
tc AS (SELECT *, {Q.PIX} AS u, {Q.elevation("z", "cr")} AS v FROM (SELECT *, {Q.R} AS cr FROM oc)),
tt AS (SELECT tc.ring, tc.ix, tc.iy, tc.v >= 0 AND tc.v < 64 AND cr > 1e-6 AS in_view, coalesce(im.r > cr + greatest(3e0 * sqrt(cr * cr * {Q.num(C.THRESHOLDS.sigma_phi_rad ** 2)} + (1.73::DOUBLE / greatest(cr, 1e-3)) * (1.73::DOUBLE / greatest(cr, 1e-3)) * 0.0004::DOUBLE), 0.3::DOUBLE), false) AS far, t.ring IS NOT NULL AS now
  FROM tc LEFT JOIN im ON im.frame = 6 AND im.v = tc.v AND im.u = tc.u LEFT JOIN (SELECT DISTINCT ring, ix, iy FROM b WHERE frame = 6) t ON t.ring = tc.ring AND t.ix = tc.ix AND t.iy = tc.iy)"""


@register(f"WITH {_THROUGH} SELECT ring, ix, iy, in_view, in_view AND far AND NOT now AS see_through, in_view AND far AND now AS protected FROM tt")
def t4_visibility(spark, sf_dir):
    return _tested(spark, sf_dir).select(*CELL, "in_view", "see_through", "protected")


@register(f"WITH {_THROUGH} SELECT 6 AS frame, count(*)::BIGINT AS tested, count(*) FILTER (NOT in_view)::BIGINT AS out_of_view, count(*) FILTER (in_view AND far AND now)::BIGINT AS protected, count(*) FILTER (in_view AND far AND NOT now)::BIGINT AS cleared FROM tt HAVING count(*) > 0")
def t5_cleanup_counters(spark, sf_dir):
    return perception.cleanup_counters(_tested(spark, sf_dir))


@register(f"WITH {Q.PTS_SQL}, {Q.IMAGE}, pb AS (SELECT frame + 1 AS frame, x - 5e-1 AS x, y, z FROM pts), qb AS (SELECT *, {Q.R} AS r FROM pb), ib AS (SELECT frame, least(greatest({Q.elevation('z', 'r')}, 0), 63) AS v, {Q.PIX} AS u, min(r) AS rb FROM qb WHERE r > 1e-6 GROUP BY ALL) SELECT frame, v, u, round(abs(r - rb), 6) AS residual, abs(r - rb) > 0.75::DOUBLE AS moved FROM im JOIN ib USING (frame, v, u) WHERE r >= 2")
def t15_residual_motion(spark, sf_dir):
    ahead = spark.range(1, 7).select(F.col("id").cast("int").alias("frame"), F.array(*map(F.lit, (1.0, 0.0, 0.0, -0.5, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0))).alias("t"))
    return perception.residual_motion(sweep_points(spark, sf_dir), ahead).select("frame", "v", "u", r6(F.col("residual")).alias("residual"), "moved")


def _curve(spark):
    """Seven vehicle poses on a curve: each frame turned a little further, climbing a little."""
    return spark.createDataFrame(I.CURVE, "frame int, t array<double>")


def _curved_motion(spark, sf_dir):
    points = sweep_points(spark, sf_dir)
    return points, perception.residual_motion(points, kitti.relative_transforms(kitti.sensor_to_world(_curve(spark))))


_CURVED = f"""{Q.PTS_SQL}, {Q.IMAGE}, rel AS (SELECT * FROM (VALUES {I.CURVE_SQL}) v(frame, t)),
pb AS (SELECT p.frame + 1 AS frame, t[1] * x + t[2] * y + t[3] * z + t[4] AS x, t[5] * x + t[6] * y + t[7] * z + t[8] AS y, t[9] * x + t[10] * y + t[11] * z + t[12] AS z FROM pts p JOIN rel ON rel.frame = p.frame + 1),
ib AS (SELECT frame, least(greatest({Q.elevation('z', 'r')}, 0), 63) AS v, {Q.PIX} AS u, min(r) AS rb FROM (SELECT *, {Q.R} AS r FROM pb) WHERE r > 1e-6 GROUP BY ALL),
mo AS (SELECT frame, v, u, abs(r - rb) AS residual, abs(r - rb) > 0.75::DOUBLE AS moved FROM im JOIN ib USING (frame, v, u) WHERE r >= 2)"""


@register(f"WITH {_CURVED} SELECT frame, v, u, round(residual, 6) AS residual, moved FROM mo")
def t15_residual_by_poses(spark, sf_dir):
    return _curved_motion(spark, sf_dir)[1].select("frame", "v", "u", r6(F.col("residual")).alias("residual"), "moved")


@register(f"WITH {_CURVED} SELECT a.frame, point_id, a.r >= 2 AND coalesce(moved, false) AS candidate FROM (SELECT *, least(greatest(v_raw, 0), 63) AS v FROM px) a LEFT JOIN mo USING (frame, v, u)")
def t15_moving_returns(spark, sf_dir):
    return perception.moving_returns(*_curved_motion(spark, sf_dir)).select("frame", "point_id", "candidate")


@register()
def j12_tracks(spark, sf_dir):
    """Tracks of the clusters in squares of 10 m, each a sequence of its own: clusters of 1 m move, meet and part within them."""
    square = lambda c: F.floor(F.col(c) / 10).cast("string")
    found = scatter.clusters(sweep_points(spark, sf_dir)).withColumns({"seq": F.concat_ws("/", square("cx"), square("cy")), "det": (F.col("cx") * 1000 + F.col("cy")).cast("int")})
    return tracks.track(found)


@register(f"WITH {Q.FOLDED}, e AS (SELECT DISTINCT ring, ix, iy FROM b WHERE moving), n AS (SELECT DISTINCT ring, ix, iy FROM b WHERE moving AND frame = 6) SELECT e.* FROM e ANTI JOIN n USING (ring, ix, iy) SEMI JOIN (SELECT * FROM st WHERE {Q.occupancy()} = 2) s USING (ring, ix, iy)")
def u2_ghosts(spark, sf_dir):
    return query.ghosts(sweep_points(spark, sf_dir), I.state(spark, sf_dir), 6)


@register(f"WITH {Q.FOLDED} SELECT ring, ix, iy, round((ix + 5e-1) * {Q.SIZE}, 6) AS x, round((iy + 5e-1) * {Q.SIZE}, 6) AS y, (CASE WHEN ceiling_cm <> 32767 THEN ceiling_cm ELSE ground_cm END) / 1e2 AS z FROM st WHERE {Q.occupancy()} = 2")
def q7_occupied(spark, sf_dir):
    return query.occupied_cells(I.state(spark, sf_dir)).withColumns({"x": r6(F.col("x")), "y": r6(F.col("y"))})


# --- refinement ------------------------------------------------------------------------


@register(f"WITH {Q.RASTER_TRAV} SELECT ring, ix, iy, ((class_byte >> 3) IN (1, 2, 5, 6, 7, 17, 18)) OR (ix + iy) % 17 = 0 OR (trav & 6 <> 0 AND {Q.decode('var_code')} > 25e0) AS fires, (ix + iy) % 17 = 0 AS dynamic FROM tr")
def f9_gate(spark, sf_dir):
    cells = I.raster_trav(spark, sf_dir)
    return refine.gate(cells, cells.where("(ix + iy) % 17 = 0").select(*CELL)).select(*CELL, "fires", "dynamic")


@register(f"WITH {Q.RASTER_TRAV}, rq AS (SELECT ring, ix, iy, round(1e0 / (1e0 + sqrt(x * x + y * y) / 10) * 4e0 * greatest(1e0 / (1e0 + CASE WHEN x > 0 THEN x / 5e0 ELSE 'inf'::DOUBLE END / 3e0), 5e-2), 9) AS score, 160000 + ((iy % 500 + 500) % 500) * 500 + (ix % 500 + 500) % 500 AS slot FROM (SELECT *, (ix + 5e-1) * 1e-1 AS x, (iy + 5e-1) * 1e-1 AS y FROM tr)) SELECT * FROM rq ORDER BY score DESC, slot LIMIT 512")
def o2_pool(spark, sf_dir):
    cells = I.raster_trav(spark, sf_dir)
    requests = refine.pool_requests(cells.withColumns({"dynamic": F.lit(True), "fires": F.lit(True)}), speed=5.0)
    return refine.admitted(requests.withColumn("score", F.round("score", 9)))


@register(f"WITH {Q.RASTER_TRAV} SELECT ring, ix, iy, child::INT AS child, ground_cm, {Q.encode('(' + Q.decode('var_code') + ' * 1e-4 + 6.25e-2 * 0e0 * 0e0 * (1e-1 * 1e-1 - 5e-2 * 5e-2) + 0e0) * 1e4')} AS var_code, (flags | 1) & 253 AS flags, trav FROM tr, range(4) r(child)")
def t13_split(spark, sf_dir):
    return refine.children_of(I.raster_trav(spark, sf_dir)).select(*CELL, "child", "ground_cm", "var_code", "flags", "trav")


@register(f"WITH {Q.WIDE_SQL}, t AS (SELECT frame, point_id, (point_id % 3 + 1) AS cur, {Q.ring('x', 'y')} AS target, {Q.d_aniso('x', 'y', '0e0')} AS d FROM wide) SELECT frame, point_id FROM t WHERE CASE WHEN d > [10, 25, 50, 100][cur + 1] * (1e0 + 1e-1) THEN CASE WHEN target = -1 THEN -1 ELSE greatest(target, cur + 1) END WHEN d < [0, 10, 25, 50][cur + 1] THEN target ELSE cur END <= cur - 1")
def o3_release(spark, sf_dir):
    blocks = wide_points(spark, sf_dir).select("frame", "point_id", (F.col("point_id") % 3 + 1).cast("int").alias("ring"), F.lit(1).alias("levels"), "x", "y")
    return refine.overtaken(blocks).select("frame", "point_id")


# --- queries -----------------------------------------------------------------------------


@register(f"WITH {Q.FOLDED}, q AS (SELECT frame, point_id, ring, ix, iy FROM b), mv AS (SELECT ring, ix, iy, greatest(max(z_cm), 0) AS m FROM b WHERE moving AND frame = 6 GROUP BY ALL) SELECT DISTINCT frame, point_id, coalesce(m, ground_cm, 0) / 1e2 AS ground_m, coalesce(ceiling_cm, 32767) / 1e2 AS ceiling_m, (coalesce(class_byte, 0) >> 3)::INT AS semantic_class, coalesce(obs_count, 0)::INT AS n, CASE WHEN m IS NOT NULL THEN 2 WHEN obs_count IS NULL THEN 0 ELSE {Q.occupancy()} END AS occupancy, m IS NOT NULL AS dynamic FROM q LEFT JOIN st USING (ring, ix, iy) LEFT JOIN mv USING (ring, ix, iy)")
def q2_points(spark, sf_dir):
    points = sweep_points(spark, sf_dir)
    asked = points.select(F.struct("frame", "point_id").alias("query_id"), "x", "y").distinct()
    moving = scatter.transient_cells(points).where("frame = 6")
    cells = I.state(spark, sf_dir).withColumn("trav", F.lit(0))
    return query.at_points(asked, cells, transient=moving).select("query_id.*", "ground_m", "ceiling_m", "semantic_class", "n", "occupancy", "dynamic")


@register(f"WITH {Q.RASTER_TRAV}, bx AS (SELECT p_partkey AS box_id, p_partkey % 448 - 224 AS x, p_size * 7 % 448 - 224 AS y, p_partkey % 9 AS s FROM part) SELECT box_id, count(*)::BIGINT AS n, bit_or(trav) AS or_mask, bit_and(trav) AS and_mask FROM bx JOIN tr ON ix BETWEEN x AND x + s AND iy BETWEEN y AND y + s GROUP BY box_id")
def q3_boxes(spark, sf_dir):
    p, z = F.col("p_partkey"), F.col("p_size")
    x, y, n = p % 448 - 224, (z * 7 % 448 - 224).cast("bigint"), p % 9
    boxes = read(spark, sf_dir, "part").select(p.alias("box_id"), F.lit(1).alias("ring"), x.alias("ix_lo"), y.alias("iy_lo"), (x + n).alias("ix_hi"), (y + n).alias("iy_hi"))
    return pyramid.box_query(I.raster_trav(spark, sf_dir), boxes)


@register(f"WITH {Q.RASTER_TRAV}, bx AS (SELECT p_partkey AS box_id, p_partkey % 448 - 224 AS x, p_size * 7 % 448 - 224 AS y, p_partkey % 9 AS s FROM part) SELECT box_id, count(*)::BIGINT AS n, bit_or(trav) AS or_mask, bit_and(trav) AS and_mask FROM bx JOIN tr ON ix BETWEEN x AND x + s AND iy BETWEEN y AND y + s GROUP BY box_id")
def q3_box_descent(spark, sf_dir):
    p, z = F.col("p_partkey"), F.col("p_size")
    x, y, n = p % 448 - 224, (z * 7 % 448 - 224).cast("bigint"), p % 9
    boxes = read(spark, sf_dir, "part").select(p.alias("box_id"), F.lit(1).alias("ring"), x.alias("ix_lo"), y.alias("iy_lo"), (x + n).alias("ix_hi"), (y + n).alias("iy_hi"))
    return pyramid.box_descent(I.raster_trav(spark, sf_dir), boxes).drop("visited")


@register(f"WITH {Q.RASTER} SELECT floor((ix + 5e-1) * 1e-1 / 3e-1)::BIGINT AS i, floor((iy + 5e-1) * 1e-1 / 3e-1)::BIGINT AS j, sum(obs_count)::BIGINT AS n, {Q.mean('sum(obs_count * ground_cm)::BIGINT', 'sum(obs_count)::BIGINT')} AS ground_cm FROM ras WHERE obs_count > 0 GROUP BY ALL")
def q8_resample(spark, sf_dir):
    return query.resampled(I.raster(spark, sf_dir), 0.3)


# --- planning ------------------------------------------------------------------------------


@register()
def g1_paths(spark, sf_dir):
    paths = planning.plan(I.cost_maps(spark, sf_dir), I.plan_queries(spark, sf_dir))
    return paths.select("window", "map_id", "query_id", r6(F.col("cost")).alias("cost"), F.size("path").alias("steps"))


@register()
def g2_distances(spark, sf_dir):
    sources = I.plan_queries(spark, sf_dir).select("window", "query_id", "si", "sj", F.lit(False).alias("reverse"))
    return planning.distances(I.cost_maps(spark, sf_dir), sources).withColumn("d", r6(F.col("d")))


@register()
def g3_corridor(spark, sf_dir):
    return planning.corridor(I.cost_maps(spark, sf_dir), I.plan_queries(spark, sf_dir)).withColumn("through", r6(F.col("through")))


@register()
def g6_regret(spark, sf_dir):
    found = planning.regret(I.cost_maps(spark, sf_dir), "fine", I.plan_queries(spark, sf_dir))
    return found.withColumns({c: r6(F.col(c)) for c in ("reference_cost", "scored_cost", "regret", "frechet_m")})


@register()
def g7_crossings(spark, sf_dir):
    return planning.crossings(I.windows(spark, sf_dir), 64, I.SPAN, I.SPAN, seed=7)


_WALK = 'wk AS (SELECT win AS "window", q.range AS query_id, k.range AS step, q.range + (k.range + 1) // 2 AS i, k.range AS j FROM (SELECT DISTINCT p_partkey // 1936 AS win FROM part), range(8) q, range(30) k)'


@register(f"""WITH {I.COST_SQL}, {_WALK}, p AS (SELECT wk.*, cost, lag(i) OVER w AS pi, lag(j) OVER w AS pj FROM (SELECT wk.*, cm.cost FROM wk JOIN cm ON map_id = 'coarse' AND cm."window" = wk."window" AND cm.i = wk.i AND cm.j = wk.j) wk WINDOW w AS (PARTITION BY "window", query_id ORDER BY step))
SELECT "window", query_id::INT AS query_id, CASE WHEN isinf(sum(cost)) THEN NULL ELSE round(sum(cost * CASE WHEN i <> pi AND j <> pj THEN sqrt(2e0) ELSE 1e0 END * 25e-2), 6) END AS scored FROM p WHERE pi IS NOT NULL GROUP BY "window", query_id""")
def w8_path_cost(spark, sf_dir):
    step = F.col("step")
    walk = I.windows(spark, sf_dir).withColumn("query_id", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(29))))
    walk = walk.select("window", "query_id", "step", (F.col("query_id") + F.floor((step + 1) / 2)).alias("i"), step.cast("bigint").alias("j"))
    found = planning.path_cost(walk, I.cost_maps(spark, sf_dir), "coarse")
    return found.withColumn("scored", F.when(F.col("scored") < float("inf"), r6(F.col("scored"))))


_SUPPORT = 's AS (SELECT "window", i, j FROM cm GROUP BY "window", i, j HAVING bool_and(NOT unknown AND trav & 32 = 0))'


@register(f"WITH {I.COST_SQL}, {_SUPPORT} SELECT * FROM s")
def j13_common_support(spark, sf_dir):
    return planning.common_support(I.cost_maps(spark, sf_dir))


@register(f'WITH {I.COST_SQL}, {_SUPPORT} SELECT "window", map_id, count(*) FILTER (NOT isinf(cost) AND s.i IS NOT NULL)::BIGINT AS open, count(*)::BIGINT AS n FROM cm LEFT JOIN s USING ("window", i, j) GROUP BY "window", map_id')
def u5_restrict(spark, sf_dir):
    maps = I.cost_maps(spark, sf_dir)
    return planning.restricted(maps, planning.common_support(maps)).groupBy("window", "map_id").agg(F.count_if(F.col("cost") < float("inf")).alias("open"), F.count(F.lit(1)).alias("n"))


@register(f"""WITH {I.COST_SQL} SELECT a."window", count(*) FILTER (a.walled AND b.walled)::BIGINT AS both, count(*) FILTER (a.walled AND NOT b.walled)::BIGINT AS only_first, count(*) FILTER (b.walled AND NOT a.walled)::BIGINT AS only_second
FROM (SELECT *, isinf(cost) AS walled FROM cm WHERE map_id = 'fine') a JOIN (SELECT *, isinf(cost) AS walled FROM cm WHERE map_id = 'coarse') b USING ("window", i, j) GROUP BY a."window" """)
def u4_walls(spark, sf_dir):
    return planning.walls(I.cost_maps(spark, sf_dir), "fine", "coarse")


# --- metrics and memory ----------------------------------------------------------------------

_COMPARED = f"""{Q.FOLDED}, {Q.MSTAR}, {Q.BLOCKS}, cp AS (SELECT s.*, n_ref, ref_var, ground_cm - ref_mean AS d, n_ref / ({Q.K.replace("ring", "s.ring")} * {Q.K.replace("ring", "s.ring")}) AS share FROM {Q.served("st")} s JOIN bl ON bl.ring = s.ring AND bl.ix = s.ix AND bl.iy = s.iy
  WHERE obs_count > 0 AND var_code > 0 AND ground_cm > -200 AND ground_cm < 600)"""


@register(f"WITH {_COMPARED}, g AS (SELECT ring, sqrt(avg(d * d)) AS rmse_cm, sqrt(avg(d * d + ref_var) FILTER (n_ref > 1)) AS il_cm, sqrt(avg(d * d) FILTER (n_ref > 1)) AS bias_cm, avg(d) FILTER (n_ref > 1) AS mean_bias_cm, avg((d > 0)::INT) FILTER (n_ref > 1) AS above_frac, sqrt(avg(ref_var) FILTER (n_ref > 1)) AS spread_cm, count(*) FILTER (n_ref > 1)::BIGINT AS n, median(share) AS cov FROM cp GROUP BY ring) SELECT ring, {', '.join(f'round({c}, 6) AS {c}' for c in ('rmse_cm', 'il_cm', 'bias_cm', 'mean_bias_cm', 'above_frac', 'spread_cm', 'cov'))}, n, CASE WHEN spread_cm > 1e-9 THEN round(il_cm / spread_cm, 6) END AS rho FROM g")
def e1_height_errors(spark, sf_dir):
    ref = reference.reference_map(sweep_points(spark, sf_dir))
    found = reference.height_errors(reference.with_share(reference.compared(I.state(spark, sf_dir), ref)))
    return found.withColumns({c: r6(F.col(c)) for c in ("rmse_cm", "il_cm", "bias_cm", "mean_bias_cm", "above_frac", "spread_cm", "rho", "cov")})


@register(f"WITH {Q.FOLDED}, {Q.MSTAR}, {Q.BLOCKS}, t AS (SELECT ring, ix, iy FROM {Q.served('bl')}), m AS (SELECT ring, ix, iy, {Q.occupancy()} = 2 AS occ, obs_count > 0 AS seen FROM {Q.served('st')}), f AS (SELECT coalesce(t.ring, m.ring) AS ring, t.ring IS NOT NULL AS truth, coalesce(occ, false) AS occ, coalesce(seen, false) AS seen FROM t FULL JOIN m ON t.ring = m.ring AND t.ix = m.ix AND t.iy = m.iy) SELECT ring, round(count(*) FILTER (truth AND occ) / nullif(count(*) FILTER (truth OR occ), 0), 6) AS iou, round(count(*) FILTER (truth AND seen) / nullif(count(*) FILTER (truth), 0), 6) AS fill FROM f GROUP BY ring")
def e3_occupancy_scores(spark, sf_dir):
    ref = reference.reference_map(sweep_points(spark, sf_dir))
    return reference.occupancy_scores(I.state(spark, sf_dir), ref).withColumns({"iou": r6(F.col("iou")), "fill": r6(F.col("fill"))})


@register(f"WITH {Q.FOLDED} SELECT ring, round(avg((ground_cm <= -200 OR ground_cm >= 600)::INT), 6) AS saturated FROM {Q.served('st')} WHERE obs_count > 0 GROUP BY ring")
def e7_saturated(spark, sf_dir):
    return reference.saturated(I.state(spark, sf_dir)).withColumn("saturated", r6(F.col("saturated")))


@register(f"""SELECT r.ring, r.cell_m, e.* EXCLUDE (ring), o.* EXCLUDE (ring), t.* EXCLUDE (ring) FROM (VALUES (0, 5e-2), (1, 1e-1), (2, 2e-1), (3, 4e-1)) r(ring, cell_m)
LEFT JOIN ({EXPECTED["e1_height_errors"]}) e USING (ring) LEFT JOIN ({EXPECTED["e3_occupancy_scores"]}) o USING (ring) LEFT JOIN ({EXPECTED["e7_saturated"]}) t USING (ring)""")
def e8_evaluation(spark, sf_dir):
    found = reference.evaluate(I.state(spark, sf_dir), reference.reference_map(sweep_points(spark, sf_dir)))
    return found.withColumns({c: r6(F.col(c)) for c in found.columns if c not in ("ring", "cell_m", "n")})


_STATE = ("ground_cm", "ceiling_cm", "var_code", "log_odds", "class_byte", "obs_count", "last_frame")


@register(f"WITH {Q.live()} SELECT ring, ix, iy, {', '.join(_STATE)} FROM s6")
def t5_live_map(spark, sf_dir):
    state, _ = live.run(I.driven_points(spark, sf_dir), I.drive())
    return state.select(*CELL, *_STATE)


@register(f"WITH {Q.live()} " + " UNION ALL ".join(f"SELECT {k} AS frame, (SELECT count(*) FROM la WHERE frame = {k})::BIGINT AS cells_touched, count(*)::BIGINT AS occupied, count(*)::BIGINT AS tested, count(*) FILTER (through)::BIGINT AS cleared, count(*) FILTER (protected)::BIGINT AS protected, count(*) FILTER (NOT in_view)::BIGINT AS out_of_view FROM q{k}" for k in range(7)))
def t5_live_counters(spark, sf_dir):
    return live.run(I.driven_points(spark, sf_dir), I.drive())[1]


@register(f"""WITH {Q.live()}, {Q.live(False, "n")}, c AS (SELECT ring, ix, iy, bool_and(moving) AS dynamic, bool_or(moving) AS mixed FROM (SELECT *, floor({Q.fd('xw')} / {Q.K})::BIGINT AS ix, floor({Q.fd('yw')} / {Q.K})::BIGINT AS iy FROM lr) GROUP BY ALL),
x AS (SELECT dynamic, mixed, s.ring IS NOT NULL AS still FROM (SELECT * FROM n6 WHERE obs_count >= 1 AND log_odds > 0) n JOIN c USING (ring, ix, iy) LEFT JOIN (SELECT * FROM s6 WHERE obs_count >= 1 AND log_odds > 0) s USING (ring, ix, iy)),
k AS (SELECT count(*) FILTER (dynamic AND NOT still)::BIGINT AS removed, count(*) FILTER (dynamic)::BIGINT AS dynamic, count(*) FILTER (NOT mixed AND still)::BIGINT AS preserved, count(*) FILTER (NOT mixed)::BIGINT AS static FROM x)
SELECT *, round(removed / dynamic, 9) AS dr, round(preserved / static, 9) AS sp, round(2 * (removed / dynamic) * (preserved / static) / (removed / dynamic + preserved / static), 9) AS f FROM k""")
def e6_dynamic_removal(spark, sf_dir):
    points = I.driven_points(spark, sf_dir)
    found = live.removal(points, live.run(points, I.drive())[0], live.run(points, I.drive(), cleanup=False)[0])
    return found.select("removed", "dynamic", "preserved", "static", *(F.round(c, 9).alias(c.lower()) for c in ("DR", "SP", "F")))


@register()
def e8_schedules(spark, sf_dir):
    points = I.driven_points(spark, sf_dir)
    ref = reference.reference_map(points.withColumn("z", F.col("zw")), xw="xw", yw="yw")
    return live.compare(points, I.drive(), (FOVEATED, C.THREE_RINGS), ref).withColumns({c: r6(F.col(c)) for c in ("rmse_cm", "il_cm", "bias_cm", "spread_cm", "rho", "iou", "fill", "cov", "saturated", "mean_bias_cm", "above_frac")})


@register()
def t12_gate(spark, sf_dir):
    cells = I.raster_trav(spark, sf_dir)
    held = refine.admitted(refine.pool_requests(refine.gate(cells.where("ix < 0")), speed=5.0)).select(*CELL, F.lit(1).alias("levels"), "score", "slot")
    return refine.apply_gate(cells, held, cells.where("(ix + iy) % 17 = 0").select(*CELL), speed=5.0)["counts"]


@register(f"WITH {Q.FOLDED} SELECT CASE {Q.occupancy()} WHEN 2 THEN 'occupied' WHEN 1 THEN 'free' ELSE 'unknown' END AS shown, ring, count(*)::BIGINT AS n FROM st GROUP BY ALL")
def r6_display_sets(spark, sf_dir):
    return query.display_sets(I.state(spark, sf_dir)).groupBy("shown", "ring").agg(F.count(F.lit(1)).alias("n"))


@register(f"""WITH {Q.FOLDED} SELECT (SELECT count(*)::BIGINT FROM st WHERE {Q.occupancy()} = 2 AND (ix + 5e-1) * {Q.SIZE} BETWEEN -5e-1 AND 4e1 AND (iy + 5e-1) * {Q.SIZE} BETWEEN -5e-1 AND 5e-1) AS ours,
(SELECT count(*)::BIGINT FROM (SELECT DISTINCT floor(x / 5e-2), floor(y / 5e-2), floor((z + 2e0) / 5e-2) FROM pts WHERE x BETWEEN -5e-1 AND 4e1 AND y BETWEEN -5e-1 AND 5e-1 AND floor((z + 2e0) / 5e-2) BETWEEN 0 AND 159)) AS dense""")
def r7_box_counts(spark, sf_dir):
    return query.box_counts(I.state(spark, sf_dir), sweep_points(spark, sf_dir), (-0.5, 40.0), (-0.5, 0.5))


@register()
def s15_sweep(spark, sf_dir):
    return synthetic.sweep(spark, frames=2, beams=32, azimuths=180, structure=True, crowd=20)


@register("SELECT * FROM (VALUES ('logical cells', 745000, 8940000), ('stored cells', 910000, 10920000), ('transient', 910000, 3640000), ('pool', 8192, 98304), ('tracks', 256, 5120), ('pyramid', 303741, 2733669)) v(item, units, bytes)")
def r1_budget(spark, sf_dir):
    return memory.budget(spark)


@register("SELECT * FROM (VALUES ('dense voxels', 2560000000, 2560000000, round(2560000000 / 8940000e0, 6)), ('uniform cells', 16000000, 192000000, round(192000000 / 8940000e0, 6))) v(name, units, bytes, ratio)")
def r3_baselines(spark, sf_dir):
    return memory.baselines(spark).withColumn("ratio", r6(F.col("ratio")))


@register(f"WITH {Q.FOLDED} SELECT ring, count(*)::BIGINT AS cells, count(*)::BIGINT * 12 AS bytes FROM st WHERE obs_count > 0 GROUP BY ring")
def r5_live_bytes(spark, sf_dir):
    return memory.live_bytes(I.state(spark, sf_dir))


@register()
def s23_map_digest(spark, sf_dir):
    return scatter.map_digest(I.state(spark, sf_dir))


@register("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def t10_event_windows(spark, sf_dir):
    found = windowed(read(spark, sf_dir, "events"))
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", r6(F.col("total")).alias("total"))


# --- further projections, filters and figures ----------------------------------------------


def _turns(spark):
    """Seven vehicle poses: turned by a 3-4-5 angle, 2 m further along x each frame."""
    return spark.range(7).select(F.col("id").cast("int").alias("frame"), F.array(*map(F.lit, (0.8, -0.6, 0.0)), F.col("id") * 2.0, *map(F.lit, (0.6, 0.8, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0))).alias("t"))


@register(f"WITH {Q.PTS_SQL} SELECT frame, point_id, round_even((0.8::DOUBLE * x - 0.6::DOUBLE * y + 2e0 * frame) * 1e6 + 0.123::DOUBLE, 0) AS xw, round_even((0.6::DOUBLE * x + 0.8::DOUBLE * y + 1e0) * 1e6 + 0.123::DOUBLE, 0) AS yw, round_even((z + 1.73::DOUBLE) * 1e6 + 0.123::DOUBLE, 0) AS zw FROM pts")
def p1_transform(spark, sf_dir):
    at = kitti.to_world(sweep_points(spark, sf_dir), _turns(spark))
    return at.select("frame", "point_id", *(scaled(F.col(c), 1e6).alias(c) for c in ("xw", "yw", "zw")))


@register("SELECT f::INT AS frame, 1.6::DOUBLE * -1 AS x, 1.2::DOUBLE AS y FROM range(1, 7) r(f)")
def p4_relative_transform(spark, sf_dir):
    t = kitti.relative_transforms(_turns(spark))
    return t.select("frame", r6(F.col("t")[3]).alias("x"), r6(F.col("t")[7]).alias("y"))


@register("SELECT DISTINCT v, least(greatest(1e0 + v / 15e0, 1e0), 2e0) AS forward, round(1e0 / (1e0 + 5e-1 * (v / 15e0)), 9) AS side FROM (SELECT l_quantity AS v FROM lineitem)")
def p7_stretch(spark, sf_dir):
    forward, side, _ = L.stretch(FOVEATED, F.col("v"))
    return read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("v")).distinct().select("v", forward.alias("forward"), F.round(side, 9).alias("side"))


@register(f"WITH {Q.PTS_SQL}, {Q.IMAGE} SELECT frame, v, u, round(least(greatest(r / 1e2, 0e0), 1e0), 9) AS r, least(greatest(x / 1e2, -1e0), 1e0) AS x, least(greatest(y / 1e2, -1e0), 1e0) AS y, least(greatest(z / 1e2, -1e0), 1e0) AS z, least(greatest(intensity / 255e0, 0e0), 1e0) AS intensity FROM im")
def p40_network_input(spark, sf_dir):
    return perception.network_input(perception.range_image(sweep_points(spark, sf_dir))).withColumn("r", F.round("r", 9))


@register(f"WITH {Q.FOLDED} SELECT ring, ix, iy, CASE WHEN sqrt(cx * cx + cy * cy) < 3.74::DOUBLE THEN 4 ELSE 0 END AS flags FROM (SELECT *, (ix + 5e-1) * {Q.SIZE} AS cx, (iy + 5e-1) * {Q.SIZE} AS cy FROM st)")
def f5_blind_cone(spark, sf_dir):
    x, y = (L.centre(F.col(i), F.col("ring"), FOVEATED) for i in ("ix", "iy"))
    return fold.mark_blind(I.state(spark, sf_dir), x, y).select(*CELL, "flags")


@register(f"WITH {Q.WIDE_SQL}, p AS (SELECT *, sqrt(x * x + y * y) AS flat FROM wide) SELECT frame, point_id FROM p WHERE degrees(atan2(z - 1.73::DOUBLE, greatest(flat, 1e-9))) BETWEEN -24.8::DOUBLE AND 2e0 AND flat > 1")
def f6_field_of_view(spark, sf_dir):
    return wide_points(spark, sf_dir).where(S.in_field_of_view(F.col("x"), F.col("y"), F.col("z"))).select("frame", "point_id")


@register(f"WITH {Q.FOLDED} SELECT ring, ix, iy FROM st WHERE {Q.occupancy()} = 2 ORDER BY {Q.OFFSET} + ((iy % {Q.SIDE} + {Q.SIDE}) % {Q.SIDE}) * {Q.SIDE} + ((ix % {Q.SIDE} + {Q.SIDE}) % {Q.SIDE}) LIMIT 200")
def o5_candidate_cap(spark, sf_dir):
    there = perception.occupied_in_frame(I.state(spark, sf_dir).withColumn("frame", F.lit(6)), F.lit(0.0), F.lit(0.0))
    return perception.capped(there, 200).select(*CELL)


@register(f"WITH {Q.FOLDED} SELECT ring, ix, iy, greatest(least(ground_cm - 100, 600), -200)::INT AS ground_cm FROM st")
def t9_rebase(spark, sf_dir):
    return I.state(spark, sf_dir).select(*CELL, fold.rebase(F.col("ground_cm"), F.lit(0.0), F.lit(1.0)).alias("ground_cm"))


@register(f"WITH {Q.FOLDED} SELECT ring, ix, iy, least(9 - last_frame, 255)::INT AS frames_since_seen FROM st")
def t11_ageing(spark, sf_dir):
    return fold.aged(I.state(spark, sf_dir), F.lit(9)).select(*CELL, "frames_since_seen")


@register("WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY p_size), d AS (SELECT n - lag(n) OVER (ORDER BY p_size DESC) AS d FROM c) SELECT count(d)::BIGINT AS pairs, count(*) FILTER (d >= 0)::BIGINT AS rising FROM d")
def w11_monotonicity(spark, sf_dir):
    return planning.monotone(read(spark, sf_dir, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n")), "p_size", "n")


@register(f"WITH {Q.BINNED}, c AS (SELECT frame, count(DISTINCT (ring, ix, iy))::DOUBLE AS n FROM b GROUP BY frame) SELECT min(n) AS least, median(n) AS median, round(quantile_cont(n, 0.95::DOUBLE), 6) AS p95, round(quantile_cont(n, 0.99::DOUBLE), 6) AS p99, max(n) AS most FROM c")
def a25_cells_per_frame(spark, sf_dir):
    n = scatter.binned(sweep_points(spark, sf_dir), FOVEATED).groupBy("frame").agg(F.count_distinct(*CELL).cast("double").alias("n"))
    q = n.agg(F.min("n").alias("least"), F.percentile("n", F.array(*map(F.lit, (0.5, 0.95, 0.99)))).alias("q"), F.max("n").alias("most"))
    return q.select("least", F.col("q")[0].alias("median"), r6(F.col("q")[1]).alias("p95"), r6(F.col("q")[2]).alias("p99"), "most")
