"""Segments and windows of series: gaps, fixed windows, bins, duty cycles, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series(keys: list[str], *order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def gap_segments(df: DataFrame, keys: list[str], time: str, max_gap: int, tie: str) -> DataFrame:
    """Adds segment: the number, from 0, of the stretch without a step above max_gap. A NULL time is a gap on both sides."""
    w = series(keys, time, tie)
    step = F.col(time) - F.lag(time).over(w)
    first = F.row_number().over(w) == 1
    cut = F.when(first, 0).when(step.isNull() | (step > max_gap), 1).otherwise(0)
    return df.withColumn("_cut", cut).withColumn("segment", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def make_windows(df: DataFrame, keys: list[str], time: str, length: int, stride: int, tie: str) -> DataFrame:
    """Rows repeated for each window that holds them, with window and pos. keys name a segment; a partial tail has no window.

    A row lies in at most ceil(length / stride) windows, so the blow-up is fixed and nothing is joined.
    """
    w = series(keys, time, tie)
    p = df.withColumn("_p", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    low = F.greatest(F.lit(0), F.ceil((F.col("_p") - length + 1) / stride)).cast("int")
    high = F.least(F.floor(F.col("_p") / stride), F.floor((F.col("_n") - length) / stride)).cast("int")
    p = p.where((F.col("_n") >= length) & (low <= high)).withColumn("window", F.explode(F.sequence(low, high)))
    return p.withColumn("pos", F.col("_p") - F.col("window") * stride).drop("_p", "_n")


def fixed_bins(df: DataFrame, keys: list[str], time: str, value: str, width: int, active: Column) -> DataFrame:
    """Bins aligned to the epoch: mean, maximum and count of the value, the share of active rows, and whether the bin has active and other rows."""
    b = df.withColumn("bin", F.floor(F.col(time) / width).cast("long"))
    return b.groupBy(*keys, "bin").agg(F.avg(value).alias("mean"), F.max(value).alias("peak"), F.count(value).alias("n"), F.avg(active.cast("double")).alias("duty"), (F.max(active.cast("int")) > F.min(active.cast("int"))).alias("is_transition"))


def duty_cycles(df: DataFrame, keys: list[str], time: str, active: Column, tie: str) -> DataFrame:
    """Adds cycle: the count of off-to-active edges so far, from 1; rows before the first edge are dropped. A row of unknown activity is off."""
    w = series(keys, time, tie)
    a = df.withColumn("_a", F.coalesce(active.cast("int"), F.lit(0)))
    edge = (F.col("_a") == 1) & (F.lag("_a").over(w) == 0)
    return a.withColumn("_e", F.coalesce(edge, F.lit(False)).cast("int")).withColumn("cycle", F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("cycle > 0").drop("_a", "_e")


def edge_events(df: DataFrame, keys: list[str], time: str, active: Column, tie: str) -> DataFrame:
    """A row per flip of a digital channel: event is 'rise' or 'fall'."""
    w = series(keys, time, tie)
    a = df.withColumn("_a", active.cast("int")).withColumn("_b", F.lag("_a").over(w))
    return a.where("_b is not null and _a <> _b").withColumn("event", F.when(F.col("_a") == 1, "rise").otherwise("fall")).drop("_a", "_b")


def contiguous_blocks(df: DataFrame, keys: list[str], time: str, n: int, tie: str) -> DataFrame:
    """Adds block, 0 to n - 1: contiguous blocks of each ordered series, their edges at round(i * rows / n)."""
    w = series(keys, time, tie)
    total = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    p = F.row_number().over(w) - 1
    edges = F.filter(F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.rint(i * F.col("_t") / n)), lambda e: e <= F.col("_p")) if n > 1 else F.array()
    return df.withColumn("_p", p).withColumn("_t", total).withColumn("block", F.size(edges).cast("long")).drop("_p", "_t")


def telemetry_windows(df: DataFrame, faults: DataFrame, keys: list[str], component: str, time: str, value: str, tie: str, rate_hz: float, length: int, stride: int) -> DataFrame:
    """keys, segment, window, t_start, t_end, samples (an array of `length` readings in order), is_faulty, post_failure: raw windows of every run with labels.

    keys (a run and its component among them) name a series; a step above three samples or five seconds, whichever is longer, begins a segment. A
    window is faulty if it ends at or after its component's first onset, and lies after failure if it ends after the first failure. Times are microseconds.
    """
    gap = int(max(3 / rate_hz, 5.0) * 1_000_000)
    w = make_windows(gap_segments(df, keys, time, gap, tie), [*keys, "segment"], time, length, stride, tie)
    g = w.groupBy(*keys, "segment", "window").agg(F.min(time).alias("t_start"), F.max(time).alias("t_end"), F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda x: x[value]).alias("samples"))  # length rows
    first = faults.groupBy(F.col(component).alias("_c")).agg(F.min("onset").alias("_onset"), F.min("failure").alias("_failure"))
    out = g.join(first, F.col(component) == F.col("_c"), "left")
    return out.withColumns({"is_faulty": F.coalesce(F.col("t_end") >= F.col("_onset"), F.lit(False)), "post_failure": F.coalesce(F.col("t_end") > F.col("_failure"), F.lit(False))}).drop("_c", "_onset", "_failure")
