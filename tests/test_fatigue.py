"""Cycles and damage by hand, and densities against their definition."""

import math

import numpy as np
import pytest

from axlewatch.operators import fatigue


def frame(spark, series):
    return spark.createDataFrame([(k, i, float(x)) for k, xs in series.items() for i, x in enumerate(xs)], "k string, i int, x double")


def test_turning_points_skip_plateaus(spark):
    got = fatigue.turning_points(frame(spark, {"a": [0, 1, 1, 2, 2, 1, 0, 3], "b": [5], "c": [4, 4, 4]}), ["k"], ["i"], "x").orderBy("k", "i").collect()
    assert [(r.k, r.x) for r in got] == [("a", 0), ("a", 2), ("a", 0), ("a", 3), ("b", 5), ("c", 4)]


@pytest.mark.parametrize(("residue", "want"), [("discard", 1), ("half", 1 + 0.5 * 6), ("full", 1 + 6)])
def test_rainflow_of_the_textbook_history(spark, residue, want):
    points = frame(spark, {"a": [-2, 1, -3, 5, -1, 3, -4, 4, -2]})
    got = fatigue.rainflow_cycles(points, "k", ["i"], "x", residue).collect()
    assert sum(r.n for r in got) == want
    assert [(r.range, r.mean) for r in got if r.n == 1.0][0] == (4.0, 1.0)
    assert fatigue.rainflow_cycles(points.limit(0), "k", ["i"], "x").count() == 0


def test_rainflow_keeps_series_apart_and_any_batch(spark):
    r = np.random.default_rng(3)
    series = {f"s{i}": r.integers(-50, 50, 400).tolist() for i in range(5)}
    points = fatigue.turning_points(frame(spark, series), ["k"], ["i"], "x")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {x.k: x.n for x in fatigue.rainflow_cycles(points, "k", ["i"], "x", "full").groupBy("k").agg({"n": "sum"}).toDF("k", "n").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, n in ((x.k, x["count"]) for x in points.groupBy("k").count().collect()):
        stack, full = [], 0
        for x in (p.x for p in points.where(points.k == k).orderBy("i").collect()):
            full += len(list(fatigue.count_cycles(stack, x)))
        assert got[k] == full + len(stack) - 1 and n == 2 * full + len(stack)


def test_miner_damage_and_loads(spark):
    cycles = spark.createDataFrame([("a", 4.0, 0.0, 1.0), ("a", 2.0, 0.0, 0.5)], "k string, range double, mean double, n double")
    assert fatigue.miner_damage(cycles, ["k"], 3.0, 100.0).first().damage == pytest.approx((8 + 0.5) / 100)
    assert fatigue.miner_damage(cycles, ["k"], 3.0, 100.0, endurance=1.5).first().damage == pytest.approx(0.08)
    assert fatigue.miner_damage(cycles, ["k"], 3.0, 100.0, 1.5, 5.0).first().damage == pytest.approx(0.08 + 0.5 / (100 * 1.5**2))
    r = fatigue.rainflow_features(cycles, ["k"]).first()
    assert (r.cycles, r.top_range, r.load_3) == (1.5, 4.0, pytest.approx(((64 + 4) / 1.5) ** (1 / 3)))


def test_density_integrates_to_variance_and_dirlik_nears_narrow_band(spark):
    n = 64
    x = np.sin(2 * np.pi * 8 * np.arange(n) / n)
    rows = spark.createDataFrame([("a", 0, i, float(v)) for i, v in enumerate(x)] + [("a", 1, 0, 1.0)], "k string, w int, pos int, v double")
    psd = fatigue.welch_psd(rows, ["k"], ["w"], "pos", "v", n)
    assert sum(r.psd for r in psd.collect()) / n == pytest.approx(0.5, rel=1e-6)
    d = fatigue.spectral_damage(fatigue.spectral_moments(psd, ["k"]), ["k"], 3.0).first()
    assert d.tovo == pytest.approx(d.narrow, rel=0.1) and math.isfinite(d.dirlik) and d.dirlik > 0
