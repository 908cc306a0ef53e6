"""Order tracking: recordings resampled from time to travelled distance, and their spectra over wavelength.

Distance grows by half a tooth at each edge of the wheel's pulse and linearly between edges. The grid of distances is
inverted by two as-of looks, back and ahead, in one sorted union of samples and grid points, so no recording is gathered.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axlewatch.operators.fatigue import welch_psd
from axlewatch.operators.segments import make_windows


def pulse_distance(df: DataFrame, keys: list[str], order: list[str], pulse: Column, half_tooth: float) -> DataFrame:
    """Adds place (from 0) and distance (from 0): the pulse's edges are half a tooth apart, what lies between is linear in time.

    Ahead of the first and behind the last edge the rate between the nearest two edges goes on. A recording with fewer than
    two edges stands still: its distance is 0. A missing pulse is low.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("place", (F.row_number().over(w) - 1).cast("long")).withColumn("_p", F.coalesce(pulse.cast("int"), F.lit(0)))
    by = Window.partitionBy(*keys).orderBy("place")
    up, down = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    x = x.withColumn("_edge", F.coalesce(F.col("_p") != F.lag("_p").over(by), F.lit(False)))
    x = x.withColumn("_k", F.sum(F.col("_edge").cast("int")).over(up))  # edges so far
    at = F.when(F.col("_edge"), F.col("place"))
    whole = Window.partitionBy(*keys)
    x = x.withColumns({"_a": F.last(at, True).over(up), "_b": F.first(at, True).over(down), "_n": F.max("_k").over(whole)})
    places = {f"_e{i}": F.max(F.when(F.col("_edge") & (F.col("_k") == k), F.col("place"))).over(whole) for i, k in (("1", F.lit(1)), ("2", F.lit(2)), ("y", F.col("_n") - 1), ("z", F.col("_n")))}
    x = x.withColumns(places)
    head = -(F.col("_e1") - F.col("place")) / (F.col("_e2") - F.col("_e1"))
    tail = F.col("_n") - 1 + (F.col("place") - F.col("_ez")) / (F.col("_ez") - F.col("_ey"))
    inner = F.col("_k") - 1 + F.when(F.col("_b") > F.col("_a"), (F.col("place") - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(0.0)
    far = half_tooth * F.when(F.col("_n") < 2, 0.0).when(F.col("_k") == 0, head).when(F.col("_b").isNull(), tail).otherwise(inner)
    x = x.withColumn("_d", far)
    return x.withColumn("distance", F.col("_d") - F.first("_d").over(by)).select(*df.columns, "place", "distance")


def resampled(df: DataFrame, keys: list[str], distance: str, place: str, value: str, dx: float) -> DataFrame:
    """keys, j, x: the value at distance j * dx, blended linearly between the samples on both sides, as far as the recording goes.

    Where the recording stands still the last sample of a distance counts. Missing values are left out. A recording that goes
    no further than four steps has no grid.
    """
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(distance).alias("_d"), F.col(place).alias("_o"), F.col(value).cast("double").alias("_v"))
    d = d.groupBy(*keys, "_d").agg(F.max_by("_v", "_o").alias("_v"))
    span = d.groupBy(*keys).agg(F.max("_d").alias("_far"), F.min("_d").alias("_near")).where(F.col("_far") - F.col("_near") > 4 * dx)
    none = F.lit(None)
    grid = span.select(*keys, F.explode(F.sequence(F.ceil(F.col("_near") / dx), F.floor(F.col("_far") / dx))).alias("j")).select(*keys, (F.col("j") * dx).alias("_d"), none.cast("double").alias("_v"), "j")
    w = Window.partitionBy(*keys).orderBy("_d")
    back, ahead = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("_v").isNotNull(), F.struct(F.col("_d").alias("d"), F.col("_v").alias("v")))
    u = d.select(*keys, "_d", "_v", none.cast("long").alias("j")).unionByName(grid).withColumn("_s", known)
    u = u.withColumns({"_l": F.last("_s", True).over(back), "_r": F.first("_s", True).over(ahead)}).where(F.col("j").isNotNull())
    a, b = F.col("_l"), F.coalesce("_r", "_l")
    t = (F.col("_d") - a["d"]) / F.nullif(b["d"] - a["d"], F.lit(0.0))
    return u.where(a.isNotNull()).select(*keys, "j", F.coalesce(a["v"] + (b["v"] - a["v"]) * t, a["v"]).alias("x"))


def wavelength_spectrum(grid: DataFrame, keys: list[str], dx: float, length: int, wavelengths: list[float]) -> DataFrame:
    """keys, wavelength, db: Welch's density of a grid in decibels at each wavelength, linear between lines and held at both ends.

    Lines under two resolutions aren't resolved and don't count. Recordings shorter than `length` points have no spectrum.
    """
    frames = make_windows(grid, keys, "j", length, length // 2, "j")
    lines = welch_psd(frames, keys, ["window"], "pos", "x", length, 1.0 / dx).where("line >= 2")
    lines = lines.select(*keys, (1.0 / F.col("hz")).alias("_w"), (10 * F.log10(F.greatest("psd", F.lit(1e-20)))).alias("_db"))
    whole = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_w", "_db"))).alias("_s"))  # half of `length` lines a recording
    points = whole.select(*keys, "_s", F.explode(F.array(*[F.lit(float(w)) for w in wavelengths])).alias("wavelength"))
    left = F.array_max(F.filter("_s", lambda s: s["_w"] <= F.col("wavelength")))
    right = F.array_min(F.filter("_s", lambda s: s["_w"] >= F.col("wavelength")))
    p = points.withColumns({"_l": F.coalesce(left, right), "_r": F.coalesce(right, left)})
    t = (F.col("wavelength") - F.col("_l._w")) / F.nullif(F.col("_r._w") - F.col("_l._w"), F.lit(0.0))
    return p.select(*keys, "wavelength", F.coalesce(F.col("_l._db") + (F.col("_r._db") - F.col("_l._db")) * t, F.col("_l._db")).alias("db"))


def log_wavelengths(low: float, high: float, n: int) -> list[float]:
    return [float(x) for x in np.geomspace(low, high, n)]


def band_levels(spectrum: DataFrame, keys: list[str], centres: list[float], wavelengths: list[float]) -> DataFrame:
    """keys, centre, db: the mean power of the wavelengths within a third of an octave around each centre; the nearest wavelength where none is inside."""
    low, high = 2 ** (-1 / 6), 2 ** (1 / 6)
    inside = {c: [w for w in wavelengths if c * low <= w < c * high] or [min(wavelengths, key=lambda w: abs(w - c))] for c in centres}
    hits = F.explode(F.filter(F.array(*[F.when(F.col("wavelength").isin(w), F.lit(float(c))) for c, w in inside.items()]), lambda c: c.isNotNull())).alias("centre")
    return spectrum.select(*keys, "db", "wavelength", hits).groupBy(*keys, "centre").agg((10 * F.log10(F.greatest(F.avg(F.pow(F.lit(10.0), F.col("db") / 10)), F.lit(1e-20)))).alias("db"))


def third_octaves(low: float, high: float) -> list[float]:
    n = round(3 * math.log2(high / low))
    return [low * 2 ** (i / 3) for i in range(n + 1)]
