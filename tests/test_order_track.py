"""A sine of known wavelength lands in its band though the speed varies; the grid equals plain interpolation."""

import math

import numpy as np
from pyspark.sql import functions as F

from axlewatch.operators import order_track


def recording(wave, n=6000):
    """A run whose speed rises and falls: place, pulse of a wheel with 2 m teeth, and a sine over distance."""
    speed = 0.05 * (1 + 0.5 * np.sin(np.arange(n) / 900))
    far = np.concatenate([[0], np.cumsum(speed)[:-1]])
    return [(i, int(math.floor(d) % 2), math.sin(2 * math.pi * d / wave)) for i, d in enumerate(far)], far


def test_distance_follows_the_pulse(spark):
    rows, far = recording(4.0, 1500)
    df = spark.createDataFrame([(1, *r) for r in rows] + [(2, i, 1, 0.0) for i in range(5)], "k long, i long, p int, x double").repartition(3)
    d = order_track.pulse_distance(df, ["k"], ["i"], F.col("p") == 1, 1.0).orderBy("k", "i").collect()
    got = np.array([r.distance for r in d if r.k == 1])
    assert np.abs(got - (far - far[0]))[50:-50].max() < 0.12 and np.all(np.diff(got) > 0)
    assert [r.distance for r in d if r.k == 2] == [0.0] * 5


def test_grid_equals_interpolation(spark):
    rng = np.random.default_rng(1)
    d = np.cumsum(rng.choice([0.0, 0.3, 0.7], 200))
    v = rng.normal(size=200)
    df = spark.createDataFrame([(1, float(a), i, float(b)) for i, (a, b) in enumerate(zip(d, v))] + [(2, 0.0, 0, 1.0), (2, 0.5, 1, None)], "k long, d double, o long, v double").repartition(4)
    got = order_track.resampled(df, ["k"], "d", "o", "v", 0.25).orderBy("k", "j").collect()
    last = {a: b for a, b in zip(d, v)}
    xs = sorted(last)
    assert {r.k for r in got} == {1} and [r.j for r in got] == list(range(math.ceil(xs[0] / 0.25), math.floor(xs[-1] / 0.25) + 1))
    assert np.allclose([r.x for r in got], np.interp([r.j * 0.25 for r in got], xs, [last[x] for x in xs]))


def test_a_wavelength_lands_in_its_band(spark):
    for wave in (3.0, 6.0):
        rows, _ = recording(wave)
        df = spark.createDataFrame([(1, *r) for r in rows], "k long, i long, p int, x double")
        d = order_track.pulse_distance(df, ["k"], ["i"], F.col("p") == 1, 1.0)
        grid = order_track.resampled(d, ["k"], "distance", "place", "x", 0.25)
        points, centres = order_track.log_wavelengths(1.0, 16.0, 96), [1.5, 3.0, 6.0, 12.0]
        bands = order_track.band_levels(order_track.wavelength_spectrum(grid, ["k"], 0.25, 256, points), ["k"], centres, points).collect()
        assert len(bands) == 4 and max(bands, key=lambda r: r.db).centre == wave
    assert len(order_track.third_octaves(1.0, 2.0)) == 4
