"""Spectra and fatigue: Welch densities, turning points, rainflow cycles, damage by cycles and by spectral moments."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def welch_psd(windows: DataFrame, series: list[str], window: list[str], pos: str, value: str, length: int, fs: float = 1.0) -> DataFrame:
    """series, line, hz, psd: one-sided density, Hann, mean removed, averaged over the windows of a series.

    A window is one array; its transform runs in Arrow batches, and its densities are averaged before the shuffle.
    """
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
    once = np.full(length // 2 + 1, 2.0)
    once[0] = 1.0
    if length % 2 == 0:
        once[-1] = 1.0
    once = once / (fs * (hann**2).sum())

    @F.pandas_udf("array<double>")
    def density(samples: pd.Series) -> pd.Series:
        x = np.stack(samples.to_numpy()).astype(np.float64) if len(samples) else np.zeros((0, length))
        spectrum = np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * hann, axis=1)
        return pd.Series(list((np.abs(spectrum) ** 2) * once))

    whole = windows.groupBy(*series, *window).agg(F.array_sort(F.collect_list(F.struct(pos, value))).alias("s"))
    whole = whole.where((F.size("s") == length) & ~F.exists("s", lambda x: x[value].isNull()))
    bins = whole.select(*series, F.posexplode(density(F.transform("s", lambda x: x[value]))).alias("line", "p"))
    return bins.groupBy(*series, "line").agg(F.avg("p").alias("psd")).select(*series, "line", (F.col("line") * fs / length).alias("hz"), "psd")


def turning_points(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The rows at local extrema of each series, with both ends; repeats of a value in a row count once; NULLs are left out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.where(F.col(value).isNotNull()).withColumn("_p", F.lag(value).over(w)).where(F.col("_p").isNull() | (F.col("_p") != F.col(value)))
    x = x.withColumn("_n", F.lead(value).over(w))
    turn = F.col("_p").isNull() | F.col("_n").isNull() | (F.signum(F.col(value) - F.col("_p")) != F.signum(F.col("_n") - F.col(value)))
    return x.where(turn).drop("_p", "_n")


def count_cycles(stack: list[float], x: float) -> Iterator[tuple[float, float]]:
    """Puts x on the stack and yields (range, mean) of each full cycle that closes by the four-point rule."""
    stack.append(x)
    while len(stack) >= 4:
        a, b, c, d = stack[-4:]
        inner = abs(c - b)
        if inner > abs(b - a) or inner > abs(d - c):
            return
        del stack[-3:-1]
        yield inner, (b + c) / 2


def rainflow_cycles(points: DataFrame, key: str, order: list[str], value: str, residue: str = "half") -> DataFrame:
    """Turning points -> key, range, mean, n. Rows stream in order, so a task holds one series' open stack only.

    residue: discard it, or count its ranges as half or full cycles.
    """
    out = T.StructType([points.schema[key], *[T.StructField(c, T.DoubleType()) for c in ("range", "mean", "n")]])
    open_n = {"discard": None, "half": 0.5, "full": 1.0}[residue]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack = None, []

        def close() -> list[tuple]:
            left = [] if open_n is None else [(now, abs(b - a), (a + b) / 2, open_n) for a, b in zip(stack, stack[1:])]
            stack.clear()
            return left

        for batch in batches:
            rows = []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != now:
                    rows += close()
                    now = k
                rows += [(k, r, m, 1.0) for r, m in count_cycles(stack, x)]
            yield table(rows)
        yield table(close())

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    ordered = points.select(key, F.col(value).cast("double").alias("_x"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)]).repartition(key)
    return ordered.sortWithinPartitions(key, *[f"_o{i}" for i in range(len(order))]).select(key, "_x").mapInArrow(each, out)


def miner_damage(cycles: DataFrame, keys: list[str], exponent: float, constant: float, endurance: float = 0.0, shallow: float | None = None) -> DataFrame:
    """keys, damage: sum of n * (range / 2) ** m / C. Below the endurance amplitude a cycle counts with the shallow exponent, or not at all."""
    amp = F.col("range") / 2
    steep = F.col("n") * F.pow(amp, F.lit(exponent)) / constant
    low = F.lit(0.0) if shallow is None else F.col("n") * F.pow(amp, F.lit(shallow)) / (constant * endurance ** (shallow - exponent))
    return cycles.groupBy(*keys).agg(F.sum(F.when(amp >= endurance, steep).otherwise(low)).alias("damage"))


def rainflow_features(cycles: DataFrame, keys: list[str], exponents: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    """keys, cycles, largest and mean range, and equivalent loads (sum n r^m / sum n) ** (1/m)."""
    n = F.sum("n")
    loads = [F.pow(F.sum(F.col("n") * F.pow("range", F.lit(float(m)))) / n, F.lit(1.0 / m)).alias(f"load_{m}") for m in exponents]
    return cycles.groupBy(*keys).agg(n.alias("cycles"), F.max("range").alias("top_range"), (F.sum(F.col("n") * F.col("range")) / n).alias("mean_range"), *loads)


def spectral_moments(psd: DataFrame, keys: list[str]) -> DataFrame:
    """keys, m0, m1, m2, m4: trapezoids of hz ** i * psd."""
    w = Window.partitionBy(*keys).orderBy("line")
    x = psd.withColumn("_h", F.lag("hz").over(w)).withColumn("_p", F.lag("psd").over(w))

    def area(i: int) -> Column:
        return F.sum((F.pow("hz", F.lit(float(i))) * F.col("psd") + F.pow("_h", F.lit(float(i))) * F.col("_p")) / 2 * (F.col("hz") - F.col("_h"))).alias(f"m{i}")

    return x.groupBy(*keys).agg(*[area(i) for i in (0, 1, 2, 4)])


def spectral_damage(moments: DataFrame, keys: list[str], m: float) -> DataFrame:
    """keys, and damage a second (constant 1) by the narrow-band, Tovo-Benasciutti and Dirlik forms. NULL where the moments vanish."""
    m0, m1, m2, m4 = (F.nullif(F.col(c), F.lit(0.0)) for c in ("m0", "m1", "m2", "m4"))
    x = moments.select(*keys, m0.alias("m0"), F.sqrt(m2 / m0).alias("nu0"), F.sqrt(m4 / m2).alias("nup"), (m1 / F.sqrt(m0 * m2)).alias("a1"), (m2 / F.sqrt(m0 * m4)).alias("a2"), (m1 / m0 * F.sqrt(m2 / m4)).alias("xm"))
    a1, a2, xm = F.col("a1"), F.col("a2"), F.col("xm")
    x = x.withColumn("d1", 2 * (xm - a2 * a2) / (1 + a2 * a2))
    d1 = F.col("d1")
    x = x.withColumn("r", (a2 - xm - d1 * d1) / (1 - a2 - d1 + d1 * d1))
    x = x.withColumn("d2", (1 - a2 - d1 + d1 * d1) / (1 - F.col("r"))).withColumn("d3", 1 - d1 - F.col("d2"))
    x = x.withColumn("q", 1.25 * (a2 - F.col("d3") - F.col("d2") * F.col("r")) / d1)
    x = x.withColumn("narrow", F.col("nu0") * F.pow(F.sqrt(2 * F.col("m0")), F.lit(m)) * math.gamma(1 + m / 2))
    x = x.withColumn("b", (a1 - a2) * (1.112 * (1 + a1 * a2 - (a1 + a2)) * F.exp(2.11 * a2) + (a1 - a2)) / ((a2 - 1) * (a2 - 1)))
    wide = d1 * F.pow("q", F.lit(m)) * math.gamma(1 + m) + 2 ** (m / 2) * math.gamma(1 + m / 2) * (F.col("d2") * F.pow(F.abs("r"), F.lit(m)) + F.col("d3"))
    return x.select(*keys, "narrow", ((F.col("b") + (1 - F.col("b")) * F.pow(a2, F.lit(m - 1))) * F.col("narrow")).alias("tovo"), (F.col("nup") * F.pow("m0", F.lit(m / 2)) * wide).alias("dirlik"))
