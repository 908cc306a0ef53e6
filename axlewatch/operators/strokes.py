"""Travel strokes, tacho speed and fingerprints of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axlewatch.operators.segments import series


def monotone_strokes(df: DataFrame, keys: list[str], time: str, value: str, tie: str, share: float = 0.05, least: int = 3) -> DataFrame:
    """Rows of the strokes of a set-point, with stroke and pos: runs of steps of one sign, with the row in which the last step ends.

    A step within share of the 95th percentile of the steps that aren't 0, to nine places, is a wait and belongs to no stroke. A row between two strokes is
    in both. Rows without a value are left out first, strokes of fewer than least rows last.
    """
    w = series(keys, time, tie)
    steps = df.where(F.col(value).isNotNull()).withColumn("_d", F.lead(value).over(w) - F.col(value))
    peak = steps.where("_d <> 0").groupBy(*keys).agg(F.expr("percentile(abs(_d), 0.95)").alias("_peak"))
    step, dead = F.round("_d", 9), F.round(share * F.col("_peak"), 9)
    x = steps.join(peak, keys).withColumn("_s", F.when(F.col("_d").isNull(), F.lit(None)).when(step > dead, 1).when(step < -dead, -1).otherwise(0))
    x = x.withColumn("_cut", (~F.col("_s").eqNullSafe(F.lag("_s").over(w))).cast("int")).withColumn("_run", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.struct(F.lag("_run").over(w).alias("run"), F.lag("_s").over(w).alias("s"))
    x = x.withColumn("_in", F.array_distinct(F.array(before, F.struct(F.col("_run").alias("run"), F.col("_s").alias("s")))))
    x = x.withColumn("_in", F.explode(F.filter("_in", lambda r: r["s"] != 0))).withColumn("stroke", F.col("_in.run"))
    by = [*keys, "stroke"]
    x = x.withColumn("pos", F.row_number().over(series(by, time, tie)) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return x.where(F.col("_n") >= least).drop("_d", "_peak", "_s", "_cut", "_run", "_in", "_n")


def stroke_features(df: DataFrame, keys: list[str], current: str, position: str, error: str, rate: float, start: int = 5) -> DataFrame:
    """A row per stroke (keys, stroke): rows and seconds at the rate, mean, rms and peak current, peak of the first rows, travel, direction, tracking error."""
    c, e = F.abs(current), F.abs(error)
    first, last, n = F.min_by(position, "pos"), F.max_by(position, "pos"), F.count(F.lit(1))
    return df.groupBy(*keys, "stroke").agg(
        n.alias("n_samples"), (n / rate).alias("duration_s"), F.avg(c).alias("i_mean"), F.sqrt(F.avg(c * c)).alias("i_rms"), F.max(c).alias("i_peak"),
        F.max(F.when(F.col("pos") < start, c)).alias("i_start_peak"), first.alias("pos_ref_start"), last.alias("pos_ref_end"), (F.max(position) - F.min(position)).alias("pos_ref_range"),
        F.signum(last - first).cast("int").alias("direction"), (F.abs(last - first) * rate / F.greatest(n - 1, F.lit(1))).alias("v_ref"),
        F.max(e).alias("pos_err_max"), F.sqrt(F.avg(e * e)).alias("pos_err_rms"),
    )


def tacho_windows(df: DataFrame, keys: list[str], time: str, high: Column, tie: str, rows: int, rate: float, metres: float) -> DataFrame:
    """keys, window, n_edges, speed_kmh: toggles of a tacho inside windows of so many rows, two toggles for each pulse of so many metres.

    A partial tail is cut off; a series shorter than a window is one window. An unknown level is low.
    """
    w = series(keys, time, tie)
    x = df.select(*keys, F.coalesce(high.cast("int"), F.lit(0)).alias("_h"), time, tie).withColumn("_p", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    x = x.withColumn("window", F.floor(F.col("_p") / rows)).withColumn("_e", F.abs(F.col("_h") - F.lag("_h").over(series([*keys, "window"], time, tie))))
    x = x.where((F.col("_n") < rows) | (F.col("window") < F.floor(F.col("_n") / rows)))
    edges = F.coalesce(F.sum("_e"), F.lit(0))
    return x.groupBy(*keys, "window").agg(edges.alias("n_edges"), (edges / 2 * metres / (F.count(F.lit(1)) / rate) * 3.6).alias("speed_kmh"))


def recording_fingerprint(df: DataFrame, keys: list[str], order: list[str], sample: Column, n: int = 1000) -> DataFrame:
    """keys and fingerprint: SHA-256 of the first n samples as text, comma-joined; an unknown sample is empty.

    A buffer holds n samples at most."""
    x = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n)
    first = F.array_sort(F.collect_list(F.struct("_r", F.coalesce(sample.cast("string"), F.lit("")).alias("v"))))
    return x.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(first, lambda s: s["v"]), ","), 256).alias("fingerprint"))


def duplicate_groups(df: DataFrame, key: str) -> DataFrame:
    """fingerprint, first (the least key) and n of the fingerprints of more than one recording."""
    return df.groupBy("fingerprint").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")


def record_group_stats(df: DataFrame, record: list[str], group: str, value: str, wanted: Column, reference: str) -> DataFrame:
    """A row per group over the medians of its records: records, median, p10, p90, and the median's ratio to the reference group's.

    Only wanted rows (a band of speeds) count. The ratio is NULL where the reference has no median or 0.
    """
    per = df.where(wanted).groupBy(*record, group).agg(F.expr(f"percentile({value}, 0.5)").alias("_m"))
    g = per.groupBy(group).agg(F.count("_m").alias("n"), *[F.expr(f"percentile(_m, {q})").alias(a) for a, q in (("median", 0.5), ("p10", 0.1), ("p90", 0.9))])
    ref = g.where(F.col(group) == reference).agg(F.max("median").alias("_ref"))  # one row by construction
    return g.join(F.broadcast(ref)).withColumn("ratio", F.col("median") / F.when(F.col("_ref") != 0, F.col("_ref"))).drop("_ref")


def power_law_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, alpha, intercept, stderr, r2, x_lo, x_hi of log y = alpha log x + intercept; rows that aren't positive don't count.

    Keys of fewer than three points, or of one x, have no row. The caller has one point for each recording.
    """
    p = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(*keys, F.log(x).alias("_x"), F.log(y).alias("_y"), F.col(x).alias("_v"))
    a = p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("_y", "_x").alias("alpha"), F.regr_intercept("_y", "_x").alias("intercept"), F.regr_sxx("_y", "_x").alias("_sxx"), F.regr_syy("_y", "_x").alias("_syy"),
        F.regr_r2("_y", "_x").alias("r2"), F.min("_v").alias("x_lo"), F.max("_v").alias("x_hi"),
    ).where("n >= 3 and x_lo < x_hi")
    rest = F.greatest(F.lit(0.0), (1 - F.col("r2")) * F.col("_syy"))
    return a.withColumn("stderr", F.sqrt(rest / (F.col("n") - 2) / F.col("_sxx"))).drop("_sxx", "_syy")
