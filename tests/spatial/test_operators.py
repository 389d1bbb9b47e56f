import math
import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrace import config as C
from terrace.operators import fold, live, perception, planning, pyramid, query, reference, refine, scatter, stencil, tracks
from terrace.operators.scatter import CELL
from terrace.plans import inputs as I
from terrace.scratch import scratch_root
from terrace.sources import kitti, synthetic
from terrace.sources.tables import sweep_points
from terrace.streaming.frames import POINTS, RunningMap, read_frames, windowed

SF = "/root/testdata/sf0.001"
FLAT = "ring int, ix bigint, iy bigint, ground_cm int, ceiling_cm int, var_code int, log_odds int, class_byte int, reflectivity int, obs_count int, frames_since_seen int, flags int, last_frame int"


def plane(spark, height, n=20, ring=1, seen=9):
    rows = [(ring, x, y, int(height(x, y)), 32767, 255, 8, 8 * 8 + 5, 0, seen, 0, 0, 0) for x in range(-n, n) for y in range(-n, n)]
    return spark.createDataFrame(rows, FLAT)


def test_scatter_does_not_depend_on_partitioning(spark):
    points = sweep_points(spark, SF)
    digests = {scatter.map_digest(scatter.frame_cells(points.repartition(n, "z"))).first() for n in (1, 7, 16)}
    assert len(digests) == 1


def test_fold_equals_a_running_merge(spark):
    cells = I.static_frames(spark, SF).cache()
    whole = fold.fold_frames(cells)
    state = cells.sparkSession.createDataFrame([], ", ".join(f"{c} {'int' if c == 'ring' else 'bigint'}" for c in CELL) + ", " + ", ".join(f"{n} {t}" for n, t, _ in fold.STATE))
    for frame in range(7):
        state = spark.createDataFrame(fold.merge_frame(state, cells.where(F.col("frame") == frame)).collect(), state.schema)
    assert scatter.map_digest(whole).first() == scatter.map_digest(state).first()


def test_stream_of_frames_ends_in_the_batch_state_and_goes_on_after_a_restart(spark, tmp_path):
    points = I.driven_points(spark, SF).where("frame < 4 AND point_id % 7 = 0")
    poses = I.drive()[:4]
    full = points.withColumns({"ego_x": 2.0 * F.col("frame"), "ego_y": F.lit(0.0), "ego_z": F.element_at(F.array(*(F.lit(p.z) for p in poses)), F.col("frame") + 1)})
    full = full.selectExpr(*(f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in POINTS.split(", ")))
    root = str(tmp_path / "map")
    for some in ((0, 1), (2, 3)):  # a new driver for the second half
        for frame in some:
            full.where(F.col("frame") == frame).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        running = RunningMap(spark, root)
        assert running.start(read_frames(spark, str(tmp_path / "in"))).awaitTermination(120)
    batch, counters = live.run(points, poses)
    assert not [p for p in os.listdir(scratch_root(spark).removeprefix("file:")) if p.startswith("fused-")]
    assert scatter.map_digest(running.state().select(batch.columns)).first() == scatter.map_digest(batch).first()
    assert len(running._batches()) == 2 and counters.count() == 4


def scene(spark, frames, car_until):
    """Flat ground, a wall, and a car that stands 8 m ahead in the first frames: frame, point_id, x, y, z, ..."""
    rows = []
    for f in range(frames):
        rows += [(f, 9.5 + 0.18 * a, -3.5 + 0.12 * b, 0.0, 8, True, False) for a in range(60) for b in range(60)]
        rows += [(f, 30.0, -6.0 + 0.02 * k, 0.3 + 0.05 * (k % 20), 12, False, False) for k in range(600)]
        rows += [(f, 8.0 + 0.05 * (k % 10), -1.0 + 0.05 * (k % 40), 0.4 + 0.1 * (k % 8), 0, False, True) for k in range(400)] if f < car_until else []
    rows = [(f, n, x, y, z - C.THRESHOLDS.sensor_height_m, c, g, m) for n, (f, x, y, z, c, g, m) in enumerate(rows)]
    at = spark.createDataFrame(rows, "frame int, point_id bigint, x double, y double, z double, cls int, ground boolean, moving boolean")
    return at.withColumns({"xw": F.col("x"), "yw": F.col("y"), "zw": F.col("z") + C.THRESHOLDS.sensor_height_m, "intensity": F.lit(0.5), "raw_label": F.lit(0)})


def test_a_run_without_cleanup_reads_the_returns_once(spark):
    reads = spark.sparkContext.accumulator(0)
    points = scene(spark, 3, 2)
    rows = points.count()

    def through(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    poses = [live.Pose(k, 0.5 * k, 0.0, 0.7 * k) for k in range(3)]
    counted = points.mapInArrow(through, points.schema)
    found, counters = live.run(counted, poses, cleanup=False)
    assert reads.value == rows and counters.count() == 3
    for n, pose in enumerate(poses):
        steps = live.aggregated_steps(points, poses).where(F.col("step") == n).drop("step")
        assert scatter.map_digest(steps).first() == scatter.map_digest(live.aggregated(points.where(F.col("frame") == pose.frame), pose).select(steps.columns)).first()
    assert found.count() > 0


def test_a_car_that_left_is_cleared_and_the_wall_is_not(spark):
    points, poses = scene(spark, 8, 2), [live.Pose(f, 0.0, 0.0) for f in range(8)]
    cleaned, counters = live.run(points, poses)
    kept, _ = live.run(points, poses, cleanup=False)
    near = lambda m: live.trail(m, 7.5, 9.0, 0.0, 1.5).count()
    wall = lambda m: live.trail(m, 29.5, 30.5, 0.0, 7.0).count()
    assert near(kept) > 0 and near(cleaned) < near(kept) / 2 and wall(cleaned) == wall(kept) > 0
    r = live.removal(points, cleaned, kept).first()
    assert r.SP == 1.0 and r.DR > 0.5 and 0 < r.F <= 1 and counters.agg(F.sum("cleared")).first()[0] > 0
    short = live.compare(points, poses, (C.FOVEATED, C.uniform(0.25, 50)), reference.reference_map(points.withColumn("z", F.col("zw"))))
    assert {(x.schedule, x.ring) for x in short.collect()} == {("5_10_20_40", k) for k in range(4)} | {("uniform_25cm", 0)}


def test_the_window_moves_and_the_band_follows(spark):
    rows = [(0, 0, 0, 100, 150), (0, 500, 0, 100, C.NO_CEILING), (3, 200, 0, 590, 600)]
    state = spark.createDataFrame(rows, "ring int, ix bigint, iy bigint, ground_cm int, ceiling_cm int")
    assert {(r.ring, r.ix) for r in live.shifted(state, live.Pose(1, 24.0, 0.0)).collect()} == {(0, 500), (3, 200)}
    up = {r.ix: (r.ground_cm, r.ceiling_cm) for r in live.followed(state, 0.0, 2.0).collect()}
    assert up == {0: (-100, -50), 500: (-100, C.NO_CEILING), 200: (390, 400)}
    far = {r.ix: (r.ground_cm, r.ceiling_cm) for r in live.followed(state, 0.0, 50.0).collect()}
    assert far[0] == (C.Z_MIN_CM, C.Z_MIN_CM) and far[500] == (C.Z_MIN_CM, C.NO_CEILING)
    assert live.Pose(0, 0, 0, -0.2).datum == -1.0 and live.Pose(0, 0, 0, 2.9).datum == 2.0
    classes = spark.createDataFrame([(None,), (-1,), (31,), (252,)], "c int")
    assert [r[0] for r in classes.select(live.guarded(F.col("c"), clip=True)).collect()] == [0, 0, 31, 31]
    with pytest.raises(Exception, match="above 31"):
        classes.select(live.guarded(F.col("c"))).collect()


def test_the_pool_keeps_the_highest_and_evicts_only_for_more(spark):
    th = C.replace(C.THRESHOLDS, pool_blocks=3)
    block = lambda *rows: spark.createDataFrame([(1, n, 0, 1, float(x), n) for n, x in rows], "ring int, ix bigint, iy bigint, levels int, score double, slot bigint")
    got = {r.ix: (r.held, r.granted, r.score) for r in refine.pooled(block((1, 5), (2, 3), (3, 3)), block((4, 3), (5, 4), (1, 1), (6, 9)).drop("levels"), th).collect()}
    assert {k for k, (_, granted, _) in got.items() if granted} == {6, 5, 2} and got[1] == (True, False, 1.0)
    free = {r.ix for r in refine.pooled(block((1, 5)), block((4, 3), (5, 3)).drop("levels"), th).where("granted").collect()}
    assert free == {1, 4, 5}


def test_the_gate_releases_first_and_splits_what_it_grants(spark):
    cells = stencil.traversability(plane(spark, lambda x, y: 0)).where("abs(ix) < 4 AND abs(iy) < 4")
    moving = cells.where("ix = 2 AND iy = 2").select(*CELL)
    overtaken = spark.createDataFrame([(1, 0, 0, 1, 9.0, 7)], refine.BLOCK)  # ring 0 serves the origin
    got = refine.apply_gate(cells, overtaken, moving)
    counts = got["counts"].first()
    assert (counts.released, counts.fired, counts.acquired, counts.refused, counts.evicted) == (1, 1, 1, 0, 0)
    assert [(r.ix, r.iy) for r in got["blocks"].collect()] == [(2, 2)] and got["children"].count() == 4
    assert {(r.ix, r.iy) for r in got["cells"].where(F.col("flags").bitwiseAND(C.FLAG_REFINED) != 0).collect()} == {(2, 2)}


def test_scenes_do_not_depend_on_partitions_and_hold_what_they_should(spark):
    whole = synthetic.sweep(spark, frames=2, beams=8, azimuths=36, structure=True, crowd=3).cache()
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    again = synthetic.sweep(spark, frames=2, beams=8, azimuths=36, structure=True, crowd=3)
    assert scatter.map_digest(whole).first() == scatter.map_digest(again).first()
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert whole.select("frame", "point_id").distinct().count() == whole.count()
    labels = {r.raw_label for r in whole.where("NOT ground").select("raw_label").distinct().collect()}
    assert labels == {50, 70, 80, 81, 252, 254} and whole.where("raw_label = 252").count() == 800
    front = whole.where("raw_label = 252").groupBy("frame").agg(F.avg("x").alias("x")).orderBy("frame").collect()
    assert front[1].x - front[0].x == pytest.approx(0.5, abs=0.2)
    assert synthetic.demo_raster(spark, 40).count() == 1600


def test_maps_are_named_saved_and_shown(spark, tmp_path):
    cells = stencil.traversability(plane(spark, lambda x, y: 7, ring=0))
    query.bind(cells, "some_map")
    assert query.bound(spark, "some_map").count() == cells.count() and spark.sql("SELECT count(*) FROM some_map").first()[0] == cells.count()
    ref = spark.createDataFrame([(1, 2, 3.0, 4, 40)], "i bigint, j bigint, height_cm double, count bigint, class_id int")
    reference.save_reference(ref, str(tmp_path / "ref"), 0.05)
    again, cell = reference.load_reference(spark, str(tmp_path / "ref"))
    assert again.collect() == ref.collect() and cell == 0.05
    shown = query.display_sets(cells).groupBy("shown").count().collect()
    assert sum(r["count"] for r in shown) == cells.count()


def test_crossings_are_seeded_and_go_from_end_to_end(spark):
    windows = spark.createDataFrame([(0,), (1,)], "window bigint")
    a, b = (sorted(map(tuple, planning.crossings(windows, 16, 40, 20, seed=3).repartition(n).collect())) for n in (1, 5))
    assert a == b and len(a) == 32 and a != sorted(map(tuple, planning.crossings(windows, 16, 40, 20, seed=4).collect()))
    for _, q, si, sj, gi, gj in a:
        assert 0 <= min(si, sj, gi, gj) and max(si, gi) < 40 and max(sj, gj) < 20
        assert (si < 10 and gi >= 30) if q % 2 == 0 else (sj < 5 and gj >= 15)


def test_poses_come_from_the_sequence_s_source(spark, tmp_path, monkeypatch):
    cloud = [(np.zeros((3, 4)), np.array([40, 252, 0]))]
    for seq in ("08", "05"):
        kitti.write_sequence(str(tmp_path), seq, cloud, [[1.0, 0, 0, 1.0, 0, 1.0, 0, 0, 0, 0, 1.0, 0]])
    with pytest.warns(RuntimeWarning, match="ground-truth"):
        assert kitti.sequence_poses(spark, str(tmp_path), "08").first().t[3] == 1.0
    (tmp_path / "sequences/08/poses.txt").write_text("1 0 0 7 0 1 0 0 0 0 1 0\n")
    assert kitti.sequence_poses(spark, str(tmp_path), "08").first().t[3] == 7.0 and kitti.sequence_poses(spark, str(tmp_path), "08", "gt").first().t[3] == 1.0
    monkeypatch.setenv(kitti.FORCED, "gt")
    assert kitti.pose_source("08") == "gt"
    monkeypatch.setenv(kitti.FORCED, "nonsense")
    with pytest.raises(ValueError, match="nonsense"):
        kitti.pose_source("05")
    monkeypatch.delenv(kitti.FORCED)
    points, transforms = kitti.scans(spark, str(tmp_path), "05")
    assert [p.frame for p in live.poses_of(transforms)] == [0]
    state, _ = live.run(points, live.poses_of(transforms))
    assert state.count() == 1 and {r.moving for r in points.collect()} == {True, False}


def test_windowed_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    q = stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("hours").agg(F.sum("n")).first()[0] == events.count()


def test_flat_ground_is_traversable_and_each_bit_fires_alone(spark):
    inner = "abs(ix) < 10 AND abs(iy) < 10"
    flat = stencil.traversability(plane(spark, lambda x, y: 0))
    assert {r.trav for r in flat.where(inner).select("trav").collect()} == {0}
    steep = stencil.traversability(plane(spark, lambda x, y: 5 * x)).where(inner)
    assert {r.trav for r in steep.select("trav").collect()} == {C.TRAV_SLOPE}
    thin = stencil.traversability(plane(spark, lambda x, y: 0, seen=2)).where(inner)
    assert {r.trav for r in thin.select("trav").collect()} == {C.TRAV_CONFIDENCE}


def test_kerb_and_pothole_are_found_and_a_lone_rock_is_not(spark):
    kerb = stencil.curbs(plane(spark, lambda x, y: 12 if x >= 0 else 0)).collect()
    assert kerb and {r.ix for r in kerb} <= {-1, 0} and {r.rise_cm for r in kerb} == {12.0}
    hole = stencil.potholes(plane(spark, lambda x, y: -40 if x * x + y * y <= 2 else 0)).collect()
    assert {(r.ix, r.iy) for r in hole} == {(x, y) for x in range(-1, 2) for y in range(-1, 2)} and {r.depth_cm for r in hole} == {40.0}
    assert stencil.curbs(plane(spark, lambda x, y: 12 if (x, y) == (0, 0) else 0)).count() == 0
    assert stencil.potholes(plane(spark, lambda x, y: 3 * x)).count() == 0


def test_pyramid_never_calls_an_unsafe_block_safe(spark):
    cells = I.raster_trav(spark, SF).cache()
    safe = pyramid.block_extent(pyramid.classified(pyramid.nodes(cells))).where(F.col("state") == pyramid.SAFE).drop("cells", "ring")
    bad = safe.join(cells.where("trav <> 0"), (F.col("ix") >= F.col("ix_lo")) & (F.col("ix") < F.col("ix_hi")) & (F.col("iy") >= F.col("iy_lo")) & (F.col("iy") < F.col("iy_hi")))
    assert bad.count() == 0


def test_split_then_merge_gives_the_cell_back(spark):
    cells = plane(spark, lambda x, y: x, n=2).withColumn("trav", F.lit(5))
    children = refine.children_of(cells)
    assert children.count() == 4 * cells.count() and {r.trav for r in children.select("trav").distinct().collect()} == {5}
    kids = children.select(*CELL, (F.col("ground_cm") / 100.0).alias("mu_m"), F.lit(0.01).alias("sigma2_m2"), F.col("obs_count").cast("bigint").alias("n"), "flags", F.xxhash64(*CELL).alias("parent_id"), (F.col("ground_cm") / 100.0).alias("parent_mu_m"), F.lit(0.004).alias("parent_sigma2_m2"), F.col("obs_count").cast("bigint").alias("parent_n"))
    back = refine.merged(kids, CELL).collect()
    assert all(r.restored and r.sigma2_m2 == 0.004 and r.mu_m == r.ix / 100.0 for r in back)


def test_variance_of_a_kerb_across_four_cells(spark):
    rows = [(1, mu, 0.0004, 1, 0, None, None, None, None) for mu in (0.0, 0.0, 0.12, 0.12)]
    one = refine.merged(spark.createDataFrame(rows, "p int, mu_m double, sigma2_m2 double, n bigint, flags int, parent_id bigint, parent_mu_m double, parent_sigma2_m2 double, parent_n bigint"), ["p"]).first()
    assert math.isclose(one.mu_m, 0.06) and math.isclose(math.sqrt(one.sigma2_m2) * 100, 6.3, abs_tol=0.05)


def test_points_outside_the_map_and_moving_ones(spark):
    cells = stencil.traversability(plane(spark, lambda x, y: 7, ring=0))
    asked = spark.createDataFrame([(1, 0.02, 0.02), (2, 500.0, 0.0), (3, 9.0, 9.0)], "query_id int, x double, y double")
    moving = spark.createDataFrame([(0, 0, 0, 90)], "ring int, ix bigint, iy bigint, ground_cm int")
    got = {r.query_id: r for r in query.at_points(asked, cells, transient=moving).collect()}
    assert got[1].dynamic and got[1].ground_m == 0.9 and got[1].occupancy == C.OCCUPIED
    assert got[2].ground_m is None and got[2].trav == C.TRAV_CONFIDENCE and got[2].occupancy == C.UNKNOWN
    assert got[3].n == 0 and got[3].occupancy == C.UNKNOWN and not got[3].dynamic


def test_a_cell_that_left_the_window_starts_anew(spark):
    rows = [(f, 0, 0, 0, 5, 5, 1, 32767, 0, 8) for f in (0, 1, 4)]
    agg = spark.createDataFrame(rows, "frame int, ring int, ix bigint, iy bigint, wz_sum bigint, w_sum bigint, n bigint, ceiling_cm int, refl_sum bigint, class_id int")
    win = spark.createDataFrame([(f, 0, x0, -200, 400) for f, x0 in enumerate((-200, -200, 300, -200, -200))], "frame int, ring int, x0 bigint, y0 bigint, side int")
    assert [r.frame for r in fold.last_islands(agg, win).collect()] == [4]


def test_closest_return_wins_its_pixel_and_empty_pixels_clear_nothing(spark):
    rows = [(0, 1, 20.0, 0.0, 0.0), (0, 0, 10.0, 0.0, 0.0), (0, 2, 10.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "frame int, point_id bigint, x double, y double, z double").withColumns({"intensity": F.lit(0.5), "moving": F.lit(False)})
    image = perception.range_image(points).collect()
    assert len(image) == 1 and image[0].point_id == 0
    cells = spark.createDataFrame([(0, 0, 1, 1, 5.0, 0.05, 1.73), (0, 0, 2, 2, -5.0, 0.0, 1.73)], "frame int, ring int, ix bigint, iy bigint, x double, y double, z double")
    far = spark.createDataFrame([(0, 9, 40.0, 0.4, 0.0)], "frame int, point_id bigint, x double, y double, z double").withColumns({"intensity": F.lit(0.5), "moving": F.lit(False)})
    none = cells.select("frame", *CELL).limit(0)
    got = {r.ix: r for r in perception.seen_through(cells, perception.range_image(far), none).collect()}
    assert got[1].see_through and not got[2].see_through
    guarded = {r.ix: r for r in perception.seen_through(cells, perception.range_image(far), cells.select("frame", *CELL)).collect()}
    assert guarded[1].protected and not guarded[1].see_through


@pytest.mark.parametrize("seed", range(6))
def test_instances_against_a_flood_fill(seed):
    rng, width = np.random.default_rng(seed), C.THRESHOLDS.azimuths
    at = {(int(v), int(u) % width): float(r) for v, u, r in zip(rng.integers(0, 12, 400), rng.integers(-12, 13, 400), rng.choice([5.0, 5.75, 6.51, 9.0], 400))}
    expected = {}
    for start in sorted(at):
        if start in expected:
            continue
        waiting = [start]
        while waiting:
            v, u = here = waiting.pop()
            if here in expected:
                continue
            expected[here] = start[0] * width + start[1]
            near = [(v + 1, u), (v - 1, u), (v, (u + 1) % width), (v, (u - 1) % width)]
            waiting += [p for p in near if p in at and abs(at[p] - at[here]) <= 0.75]
    keys = list(at)
    rng.shuffle(keys)
    pixels = pd.DataFrame([(v, u, at[v, u]) for v, u in keys], columns=["v", "u", "r"])
    got = perception._labelled(pixels)
    assert {(r.v, r.u): r.instance for r in got.itertuples()} == expected


def test_instances_need_four_pixels_and_wrap_around(spark):
    pixels = [(0, 5, u, 10.0) for u in (510, 511, 0, 1)] + [(0, 30, u, 10.0) for u in (100, 101)] + [(0, 40, u, 8.0 if u < 204 else 9.0) for u in range(200, 208)]
    image = spark.createDataFrame(pixels, "frame int, v int, u int, r double").withColumns({"moving": F.lit(True), "x": F.col("r"), "y": F.lit(0.0), "z": F.lit(0.0)})
    assert sorted(r.n for r in perception.instances(image).collect()) == [4, 4, 4]


def wall(spark, gap):
    rows = [(0, "m", i, j, math.inf if i == 20 and j < 32 and not gap <= j < gap + 3 else 1.0) for i in range(40) for j in range(40)]
    return spark.createDataFrame(rows, "window bigint, map_id string, i bigint, j bigint, cost double")


def test_paths_are_optimal_and_agree_with_distances(spark):
    maps = wall(spark, 10)
    ask = spark.createDataFrame([(0, 0, 2, 10, 37, 10)], "window bigint, query_id int, si int, sj int, gi int, gj int")
    got = planning.plan(maps, ask).first()
    d = planning.distances(maps, ask.select("window", "query_id", "si", "sj", F.lit(False).alias("reverse"))).where("i = 37 AND j = 10").first().d
    assert math.isclose(got.cost, d) and math.isclose(got.cost, 35 * 0.25) and len(got.path) == 36
    steps = planning.steps_of(planning.plan(maps, ask)).drop("map_id")
    assert math.isclose(planning.path_cost(steps, maps, "m").first().scored, got.cost)


def test_distances_and_paths_against_plain_relaxation():
    rng = np.random.default_rng(6)
    for n in range(12):
        nx, ny = rng.integers(3, 9, 2)
        cost = np.where(rng.random((nx, ny)) < 0.25, np.inf, rng.integers(1, 6, (nx, ny)).astype(float))
        lattice = planning.Lattice(cost.reshape(-1), nx, ny, 0.25)
        a, b = (tuple(int(rng.integers(k)) for k in (nx, ny)) for _ in "ab")
        for reverse in (False, True):
            want = np.full((nx, ny), np.inf)
            if np.isfinite(cost[a]):
                want[a] = 0.0
            for _ in range(nx * ny):
                for i in range(nx):
                    for j in range(ny):
                        for di, dj, length in planning.STEPS:
                            p = (i + di, j + dj)
                            if 0 <= p[0] < nx and 0 <= p[1] < ny and np.isfinite(cost[i, j]) and np.isfinite(cost[p]):
                                want[i, j] = min(want[i, j], want[p] + (cost[p] if reverse else cost[i, j]) * length * 0.25)
            got = lattice.distances(lattice.index(*a), reverse).reshape(nx + 2, ny + 2)[1:-1, 1:-1]
            assert np.allclose(got, want)
            if not reverse:
                path, paid = lattice.path(lattice.index(*a), lattice.index(*b))
                open_ends = np.isfinite(cost[a]) and np.isfinite(cost[b])
                assert np.isclose(paid, want[b] if open_ends else np.inf)
                steps = [(c["i"], c["j"]) for c in lattice.cells(path)]
                assert not steps or (steps[0] == a and steps[-1] == b)
                assert all(max(abs(p[0] - q[0]), abs(p[1] - q[1])) == 1 for p, q in zip(steps, steps[1:], strict=False))


def test_regret_is_zero_on_the_same_map_and_never_negative(spark):
    both = wall(spark, 10).unionByName(wall(spark, 25).withColumn("map_id", F.lit("other")))
    ask = spark.createDataFrame([(0, q, 2, 5 * q, 37, 10) for q in range(4)], "window bigint, query_id int, si int, sj int, gi int, gj int")
    got = planning.regret(both, "m", ask).collect()
    assert all(abs(r.regret) < 1e-9 and r.frechet_m == 0 for r in got if r.map_id == "m")
    assert all(r.blocked or r.regret >= -1e-9 for r in got if r.map_id == "other")


def test_frechet_against_dynamic_programming(spark):
    rng = np.random.default_rng(4)
    a, b = ([{"i": int(i), "j": int(j)} for i, j in rng.integers(0, 20, (n, 2))] for n in (9, 13))
    d = np.array([[math.hypot(p["i"] - q["i"], p["j"] - q["j"]) * 0.25 for q in b] for p in a])
    ca = np.full(d.shape, np.inf)
    for i in range(len(a)):
        for j in range(len(b)):
            before = [ca[i - 1, j] if i else np.inf, ca[i, j - 1] if j else np.inf, ca[i - 1, j - 1] if i and j else np.inf]
            ca[i, j] = max(d[i, j], min(before) if i or j else 0)
    got = spark.createDataFrame([(a, b)], "a array<struct<i:int,j:int>>, b array<struct<i:int,j:int>>").select(planning.frechet(F.col("a"), F.col("b"), 0.25).alias("f")).first().f
    assert math.isclose(got, ca[-1, -1])


def test_frechet_of_long_paths_and_of_none(spark):
    rng = np.random.default_rng(5)
    a, b = (np.cumsum(rng.integers(-1, 2, (n, 2)), axis=0) for n in (2000, 1700))
    begun = time.perf_counter()
    squared = planning.coupling(a.astype(float), b.astype(float))
    assert time.perf_counter() - begun < 1
    d = ((a[:, None] - b[None]) ** 2).sum(axis=2).astype(float)
    row = np.maximum.accumulate(d[0])
    for i in range(1, len(a)):
        before, left, row = row, np.inf, np.empty(len(b))
        for j in range(len(b)):
            left = row[j] = max(d[i, j], min(left, before[j], before[j - 1] if j else np.inf))
    assert squared == row[-1]
    one = [{"i": 3, "j": 4}]
    rows = [(one, [{"i": 0, "j": 0}]), (one, []), (None, one), (one, one)]
    got = spark.createDataFrame(rows, "a array<struct<i:int,j:int>>, b array<struct<i:int,j:int>>").select(planning.frechet(F.col("a"), F.col("b"), 0.5).alias("f")).collect()
    assert [r.f for r in got] == [2.5, None, None, 0.0]


def test_tracks_survive_a_gap_and_then_expire(spark):
    det = [("s", f, 0, 0.1 * f, 0.0, 5) for f in (0, 1, 2)] + [("s", f, 0, 0.1 * f, 0.0, 5) for f in (9,)] + [("s", 30, 0, 90.0, 0.0, 5)]
    rows = tracks.track(spark.createDataFrame(det, "seq string, frame int, det int, x double, y double, class_id int")).collect()
    assert {r.track_id for r in rows if r.frame <= 19} == {1}
    assert {r.track_id for r in rows if r.frame == 30} == {2} and not [r for r in rows if 20 <= r.frame < 30]
    full, _ = tracks.advance(tracks.NO_TRACKS, np.array([(10.0 * k, 0.0, 0) for k in range(300)]), 1)
    assert len(full) == C.THRESHOLDS.track_capacity


def test_recorded_sequence_round_trip(spark, tmp_path):
    rng = np.random.default_rng(5)
    clouds = [(rng.normal(size=(50, 4)).astype("f4"), rng.integers(0, 260, 50).astype("u4")) for _ in range(3)]
    poses = [[1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 2.0 * n] for n in range(3)]
    kitti.write_sequence(str(tmp_path), "99", clouds, poses)
    got = kitti.sweeps(spark, str(tmp_path), start_frame=1).orderBy("frame", "point_id").collect()
    assert len(got) == 100 and [r.raw_label for r in got[:50]] == clouds[1][1].tolist() and np.allclose([r.x for r in got[50:]], clouds[2][0][:, 0])
    assert kitti.sweeps(spark, str(tmp_path), max_frames=1).count() == 50
    assert kitti.completeness(spark, str(tmp_path)).first().complete
    tr = kitti.calibration(spark, f"{tmp_path}/sequences/99/calib.txt")
    world = kitti.vehicle_to_world(kitti.poses(spark, f"{tmp_path}/poses/99.txt"), tr)
    at = {r.frame: r.t for r in world.collect()}
    assert [round(at[n][3], 9) for n in range(3)] == [0.0, 2.0, 4.0] and abs(at[0][11] + kitti.SENSOR_HEIGHT_M) < 1e-9
    assert {r.speed_ms for r in kitti.speeds(world).collect()} == {0.0, 20.0}


def test_beams_meet_the_terrain(spark):
    hits = synthetic.scan(spark, beams=16, azimuths=60)
    far = hits.select(F.abs(F.col("z") - synthetic.terrain_height(F.col("xw"), F.col("y"))).alias("d")).agg(F.max("d")).first()[0]
    assert hits.count() > 200 and far < 1e-9


def test_reference_blocks_against_numpy(spark):
    ref = reference.reference_map(sweep_points(spark, SF)).cache()
    rows = ref.collect()
    blocks = {}
    for r in rows:
        blocks.setdefault((r.i // 4, r.j // 4), []).append(r.height_cm)
    got = {(r.ix, r.iy): r for r in reference.ring_blocks(ref).where("ring = 2").collect()}
    assert got.keys() == blocks.keys()
    assert all(g.n_ref == len(blocks[k]) and math.isclose(g.ref_var, np.var(blocks[k]), abs_tol=1e-6) for k, g in got.items())


def test_evaluation_has_a_row_for_every_ring(spark):
    empty = plane(spark, lambda x, y: 0, n=1, ring=0).where("false")
    got = reference.evaluate(empty, reference.reference_map(sweep_points(spark, SF))).collect()
    assert sorted(r.ring for r in got) == [0, 1, 2, 3] and all(r.rmse_cm is None for r in got)


def test_a_refined_cell_answers_for_its_points(spark):
    cells = plane(spark, lambda x, y: 0, n=200, ring=1).where("ix = 110 AND iy = 0").withColumn("trav", F.lit(7))
    fine = refine.children_of(cells).withColumn("ground_cm", F.lit(10) * F.col("child"))
    # ring 1 cell (110, 0) spans x 11.0 to 11.1 and y 0 to 0.1; children go along x, then y
    asked = spark.createDataFrame([(0, 11.02, 0.02), (1, 11.07, 0.02), (2, 11.02, 0.07), (3, 11.07, 0.07)], "query_id int, x double, y double")
    got = {r.query_id: (round(r.ground_m * 100), r.trav) for r in query.at_points(asked, cells, refined=fine).collect()}
    assert got == {0: (0, 7), 1: (10, 7), 2: (20, 7), 3: (30, 7)}


def test_inverse_undoes_a_pose():
    t = [0.8, -0.6, 0.0, 3.0, 0.6, 0.8, 0.0, -1.0, 0.0, 0.0, 1.0, 2.0]
    assert np.allclose(kitti._product(kitti.inverse(t), t), [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0])


def test_ground_far_from_zero_is_refused(spark):
    points = spark.createDataFrame([(0, True, 5.0)] * 3, "frame int, ground boolean, zw double")
    try:
        kitti.check_upright(points, 0)
    except ValueError:
        return
    raise AssertionError("poses in another frame were accepted")


def test_box_descent_reads_about_as_many_nodes_as_the_border_has_cells(spark):
    cells = I.raster_trav(spark, SF).cache()
    sizes = (1, 2, 7, 31, 64, 100, 300)
    boxes = spark.createDataFrame([(k, 1, -224 + 3 * k, -224 + 5 * k, -225 + 3 * k + n, -225 + 5 * k + n) for k, n in enumerate(sizes)] + [(99, 1, 240, 240, 400, 400)], "box_id int, ring int, ix_lo bigint, iy_lo bigint, ix_hi bigint, iy_hi bigint")
    own = {r.box_id: (r.n, r.or_mask, r.and_mask, r.visited) for r in pyramid.box_descent(cells, boxes).collect()}
    plain = {r.box_id: (r.n, r.or_mask, r.and_mask) for r in pyramid.box_query(cells, boxes).collect()}
    assert {k: v[:3] for k, v in own.items()} == plain
    covered = {r.box_id: (r.nodes, r.cells) for r in pyramid.cover(boxes).groupBy("box_id").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.expr("shiftleft(1, 2 * level)")).alias("cells")).collect()}
    for k, n in enumerate(sizes):
        assert covered[k][1] == n * n and covered[k][0] <= max(4, 8 * n)
    assert own[6][3] <= 8 * 300 and own[6][3] < own[6][0] and covered[99][1] == 10 * 10  # clipped to the window


def test_nodes_of_boxes_are_never_broadcast_and_equal_boxes_are_covered_once(spark, tmp_path):
    spark.range(4000).selectExpr("id box_id", "1 ring", "id % 50 - 25 ix_lo", "id % 20 - 10 iy_lo", "id % 50 - 17 ix_hi", "id % 20 - 2 iy_hi").write.parquet(str(tmp_path / "boxes"))
    boxes, cells = spark.read.parquet(str(tmp_path / "boxes")), plane(spark, lambda x, y: 0).withColumn("trav", F.lit(3))
    descent, plain = pyramid.box_descent(cells, boxes), pyramid.box_query(cells, boxes)
    for found in (descent, plain):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    seen = lambda at: sum(-20 <= x < 20 for x in range(at, at + 9))
    want = {k: n for k in range(4000) if (n := seen(k % 50 - 25) * seen(k % 20 - 10))}
    assert {r.box_id: r.n for r in descent.collect()} == want == {r.box_id: r.n for r in plain.collect()}
    assert pyramid.cover(pyramid._each_once(boxes)).select("box_id").distinct().count() == 100


def test_tiles_do_not_show_at_their_edges(spark):
    """A kerb and a pothole that cross tile borders, as far from them and across them."""
    kerb = {(r.ix, r.iy) for r in stencil.curbs(plane(spark, lambda x, y: 12 if y >= 0 else 0)).collect()}
    assert kerb and {y for _, y in kerb} <= {-1, 0}
    plan = stencil.potholes(plane(spark, lambda x, y: 0))._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1


def _in_files(df, path, frames):
    """One file a frame, in order of time."""
    import time

    for k in frames:
        df.where(F.col("frame") == k).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)


def test_tracks_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    """Gaps of 10 and 11 frames, a slow mover, several sequences, several frames in one trigger."""
    schema = "seq string, frame int, det int, x double, y double, class_id int"
    det = [("a", f, 0, 0.1 * f, 0.0, 5) for f in (0, 1, 2, 12, 13, 24)] + [("a", 24, 1, 50.0, 0.0, 6), ("b", 3, 0, 1.0, 1.0, 7), ("b", 13, 0, 1.5, 1.0, 7), ("c", 0, 0, 0.0, 0.0, 1), ("c", 30, 0, 1.0, 0.0, 1)]
    found = spark.createDataFrame(det, schema)
    want = sorted(map(tuple, tracks.track(found).collect()))
    for cuts in ([(0, 2), (3, 12), (13, 23), (24, 40)], [(0, 40)]):
        path, name = str(tmp_path / f"in{len(cuts)}"), f"tracks{len(cuts)}"
        for a, b in cuts:
            found.where(F.col("frame").between(a, b)).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        q = tracks.track_stream(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).collect())) == want


def test_residual_motion_follows_the_sensor(spark):
    """A wall seen from a turning, moving sensor leaves no residual; a box that moved does, on each of its returns."""
    from terrace.sources import kitti

    poses = spark.createDataFrame(I.CURVE, "frame int, t array<double>")
    relative = kitti.relative_transforms(kitti.sensor_to_world(poses))
    world = [(0.2 * a, 12.0 + 0.05 * a, 0.3 * h) for a in range(-40, 41) for h in range(-2, 3)]
    rows = []
    for k, t in I.CURVE:
        back = kitti.inverse(kitti._product(t, [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, kitti.SENSOR_HEIGHT_M]))
        for n, (x, y, z) in enumerate([*world, *((6.0 + 1.5 * k, -5.0 + 0.02 * b, 0.5) for b in range(8))]):
            p = [back[4 * r] * x + back[4 * r + 1] * y + back[4 * r + 2] * z + back[4 * r + 3] for r in range(3)]
            rows.append((k, n, *p, 0.5, n >= len(world)))
    points = spark.createDataFrame(rows, "frame int, point_id bigint, x double, y double, z double, intensity double, moving boolean").cache()
    motion = perception.residual_motion(points, relative).cache()
    assert motion.where("frame = 0").count() == 0 and motion.where("NOT moved").count() > 500
    flagged = perception.moving_returns(points, motion).where("candidate").groupBy("moving").count().collect()
    assert all(r.moving for r in flagged) or {r.moving: r["count"] for r in flagged}.get(False, 0) <= 0.02 * len(world) * 7


def test_residual_motion_of_a_stream_equals_that_of_a_batch(spark, tmp_path):
    from terrace.sources import kitti
    from terrace.sources.tables import sweep_points

    schema = "frame int, point_id bigint, x double, y double, z double, ts timestamp"
    points = sweep_points(spark, SF).select("frame", "point_id", "x", "y", "z", F.timestamp_micros(F.col("frame") * 100_000).alias("ts"))
    relative = kitti.relative_transforms(kitti.sensor_to_world(spark.createDataFrame(I.CURVE, "frame int, t array<double>"))).cache()
    last = points.select(F.lit(20).alias("frame"), F.lit(0).cast("bigint").alias("point_id"), *(F.lit(0.0).alias(c) for c in "xyz"), F.timestamp_micros(F.lit(2_000_000)).alias("ts")).limit(1)
    _in_files(points.unionByName(last), str(tmp_path / "in"), [*range(7), 20])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = perception.residual_motion_stream(stream, relative).writeStream.format("memory").queryName("residual").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    key = lambda df: sorted((r.frame, r.v, r.u, round(r.residual, 9), r.moved) for r in df.collect())
    want = key(perception.residual_motion(points, relative))
    got = key(spark.table("residual"))
    assert got == [r for r in want if r[0] <= max(x[0] for x in got)] and len(got) > 50
