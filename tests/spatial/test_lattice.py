import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace import config as C
from terrace.functions import lattice as L
from terrace.functions import measure as M


def test_floor_division_matches_python_on_cell_borders(spark):
    xs = [k * 0.05 for k in range(-400, 401)] + [k * 0.5 for k in range(-40, 41)] + list(np.random.default_rng(1).uniform(-100, 100, 3000))
    rows = spark.createDataFrame([(float(x),) for x in xs], "x double").select("x", L.floor_div(F.col("x"), 0.05).alias("i")).collect()
    assert all(r.i == int(r.x // 0.05) for r in rows)


def test_cells_nest_exactly(spark):
    xs = np.random.default_rng(2).uniform(-100, 100, 5000)
    rows = spark.createDataFrame([(float(x),) for x in xs], "x double").select(*(L.idiv(L.floor_div(F.col("x"), 0.05), k).alias(f"k{k}") for k in (1, 2, 4, 8))).collect()
    for r in rows:
        assert r.k2 == r.k1 // 2 and r.k4 == r.k2 // 2 and r.k8 == r.k4 // 2


@pytest.mark.parametrize("schedule", [C.FOVEATED, C.THREE_RINGS])
def test_rings_cover_the_map_and_borders_go_outwards(spark, schedule):
    points = [(0.0, 0.0), (10.0, 0.0), (9.999, 9.999), (25.0, 3.0), (-10.0, 0.0), (-49.0, 0.0), (-51.0, 0.0), (99.9, 0.0), (100.0, 0.0), (0.0, -100.0)]
    got = [r.ring for r in spark.createDataFrame(points, "x double, y double").select(L.ring_of(F.col("x"), F.col("y"), schedule).alias("ring")).collect()]
    assert got[0] == 0 and got[1] == 1 and got[2] == 0 and got[3] == 2 and got[8] == -1 and got[9] == -1
    if schedule is C.FOVEATED:
        assert got[5] == 2 and got[6] == 3


def test_stored_slots_are_distinct_within_a_window(spark):
    cells = spark.range(-5, 5).select(F.col("id").alias("ix")).crossJoin(spark.range(-5, 5).select(F.col("id").alias("iy"))).withColumn("ring", F.lit(2))
    assert cells.select(L.slot(F.col("ix"), F.col("iy"), F.col("ring"), C.FOVEATED)).distinct().count() == 100


def test_annulus_index_counts_every_cell_once(spark):
    side, low, high = 20, 6, 14
    grid = spark.range(side * side).select((F.col("id") % side).alias("i"), F.floor(F.col("id") / side).alias("j"))
    got = [r.s for r in grid.select(L.annulus_index(F.col("i"), F.col("j"), side, low, high).alias("s")).collect()]
    kept = sorted(s for s in got if s >= 0)
    assert kept == list(range(side * side - (high - low) ** 2)) and got.count(-1) == (high - low) ** 2


def test_variance_code_never_claims_less_variance_than_there_is(spark):
    values = list(np.exp(np.random.default_rng(3).uniform(math.log(1 / 12), math.log(640000), 2000)))
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", M.decode_variance(M.encode_variance(F.col("v"))).alias("d")).collect()
    assert all(r.d >= r.v * (1 - 1e-12) for r in rows)


def test_integer_mean_rounds_half_away_from_zero(spark):
    cases = [(5, 2), (-5, 2), (7, 2), (-7, 2), (0, 0), (1000 * 2**30 + 1, 2**31), (-600 * 2**40, 2**40)]
    rows = spark.createDataFrame(cases, "wz bigint, w bigint").select("wz", "w", M.mean_height(F.col("wz"), F.col("w")).cast("bigint").alias("m")).collect()
    for r in rows:
        exact = Fraction(r.wz, max(r.w, 1))
        assert r.m == int(math.copysign(math.floor(abs(exact) + Fraction(1, 2)), exact)) if exact else r.m == 0


def test_votes_saturate_and_turn(spark):
    # seven for the road after nine votes; eight against turn it into one for the car
    votes = spark.createDataFrame([([8] * 9 + [0] * 8,)], "v array<int>").select(F.aggregate("v", F.lit(0), lambda a, v: M.vote(a, v)).alias("p")).first().p
    assert votes >> 3 == 0 and votes & 7 == 1


def test_schedules_are_checked():
    assert sum(b.cells for b in C.FOVEATED.bands) == 745_000 and sum(b.cells for b in C.THREE_RINGS.bands) == 520_000
    for rings in (((10, 0.05), (25, 0.12)), ((10, 0.05), (5, 0.10)), ((10, 0.07),), ((10.01, 0.20),)):
        with pytest.raises(C.ConfigError):
            C.schedule("bad", rings)
    with pytest.raises(C.ConfigError):
        C.schedule("miscounted", ((10, 0.05),), cells=(5,))
    read = C.parse_schedule('{"name": "x", "slack": 0.2, "rings": [{"reach_m": 10, "cell_m": 0.05, "cells": 160000}, {"reach_m": 20, "cell_m": 0.1}]}')
    assert [b.side for b in read.bands] == [400, 400] and read.slack == 0.2 and read.bands[1].first == 160_000
    for text in ('{"name": "x"}', '{"name": "x", "rings": [{"reach_m": 10, "cell_m": 0.05}], "colour": 1}'):
        with pytest.raises(C.ConfigError):
            C.parse_schedule(text)
    assert C.parse_thresholds('{"min_obs": 5, "curb_cm": [4, 20]}') == C.replace(C.THRESHOLDS, min_obs=5, curb_cm=(4, 20))
    with pytest.raises(C.ConfigError):
        C.parse_thresholds('{"nothing": 1}')
    assert C.class_name(8) == "road" and C.class_name(31) == "unlabeled"
    for bad in (-1, 32):
        with pytest.raises(C.ConfigError):
            C.class_name(bad)
    assert C.notes(C.uniform(0.05, 100)) and not C.notes(C.schedule("fits", ((10, 0.05),)))
    assert C.uniform(0.25, 10).bands[0].side == 80 and C.baseline_cells(0.05, 0.5) == 5 and C.baseline_cells(0.4, 0.5) == 1
    with pytest.raises(C.ConfigError):
        C.frozen("0" * 64)
