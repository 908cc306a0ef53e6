"""Features: window statistics, peers, robust baselines, sequential statistics as window algebra."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def window_stats(df: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """mean, std (population), min, max, slope, rms, kurtosis (not excess), crest; all NULL below two finite samples."""
    g = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.regr_slope(F.col(value), F.col(pos)).alias("slope"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), (F.kurtosis(value) + 3).alias("kurtosis"), F.max(F.abs(value)).alias("_top"),
    )
    g = g.withColumn("crest", F.col("_top") / F.nullif(F.col("rms"), F.lit(0.0))).drop("_top")
    stats = ["mean", "std", "min", "max", "slope", "rms", "kurtosis", "crest"]
    return g.select(*keys, "n", *[F.when(F.col("n") >= 2, F.col(s)).alias(s) for s in stats])


def window_stats_ac(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rms and crest of samples less their mean."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("rms_ac"), F.min(value).alias("a"), F.max(value).alias("b"))
    return g.select(*keys, F.when(F.col("n") >= 2, F.col("rms_ac")).alias("rms_ac"), F.when(F.col("n") >= 2, F.greatest(F.col("b") - F.col("m"), F.col("m") - F.col("a")) / F.nullif(F.col("rms_ac"), F.lit(0.0))).alias("crest_ac"))


def shape_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """skewness (population), peak to peak, and the shape, impulse, margin and waveform factors."""
    a = F.abs(value)
    g = df.groupBy(*keys).agg(F.skewness(value).alias("skew"), (F.max(value) - F.min(value)).alias("p2p"), F.avg(a).alias("m"), F.avg(F.sqrt(a)).alias("r"), F.max(a).alias("top"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    return g.select(*keys, "skew", "p2p", (F.col("rms") / F.col("m")).alias("shape"), (F.col("top") / F.col("m")).alias("impulse"), (F.col("top") / (F.col("r") * F.col("r"))).alias("margin"))


def peer_normalise(df: DataFrame, group: list[str], value: str, min_peers: int = 2) -> DataFrame:
    """Leave-one-out delta and z of a value in its group (population spread of the others); NULL below min_peers others."""
    w = Window.partitionBy(*group)
    n, s, q = F.count(value).over(w) - 1, F.sum(value).over(w) - F.col(value), F.sum(F.col(value) * F.col(value)).over(w) - F.col(value) * F.col(value)
    x = df.withColumn("_n", n).withColumn("_m", F.when(n > 0, s / n)).withColumn("_q", F.when(n > 0, q / n))
    sd = F.sqrt(F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(0.0)))
    ok = F.col("_n") >= min_peers
    return x.withColumn("peer_delta", F.when(ok, F.col(value) - F.col("_m"))).withColumn("peer_z", F.when(ok & (sd > 1e-6), (F.col(value) - F.col("_m")) / sd)).drop("_n", "_m", "_q")


def robust_baseline(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A row per key: centre (median) and spread (1.4826 MAD, else population deviation, else 1)."""
    c = df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("centre"))
    d = df.join(c, keys).groupBy(*keys).agg(F.first("centre").alias("centre"), (F.percentile(F.abs(F.col(value) - F.col("centre")), 0.5) * 1.4826).alias("mad"), F.stddev_pop(value).alias("sd"))
    return d.select(*keys, "centre", F.when(F.col("mad") > 0, F.col("mad")).when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0)).alias("spread"))


def cusum_two_sided(df: DataFrame, keys: list[str], order: list[str], z: Column, k: float = 0.5) -> DataFrame:
    """Adds cusum: the larger of both one-sided sums. By Lindley's identity S_i = P_i - min(0, min of P up to i), so it needs running windows only."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("_z", z).withColumn("_u", F.sum(F.col("_z") - k).over(w)).withColumn("_d", F.sum(-F.col("_z") - k).over(w))
    up, down = (F.col(c) - F.least(F.lit(0.0), F.min(c).over(w)) for c in ("_u", "_d"))
    return x.withColumn("cusum", F.greatest(up, down)).drop("_z", "_u", "_d")


def ewma(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float) -> DataFrame:
    """keys, order columns, ewma (adjust=False): a row per reading. A NULL or NaN carries the last mean; before the first value it is NULL.

    Rows stream in order through the task of their series, which holds one number.
    """
    schema = T.StructType([*[df.schema[c] for c in (*keys, *order)], T.StructField("ewma", T.DoubleType())])
    width = len(keys)

    step = 128
    lag = np.arange(step)[:, None] - np.arange(step)[None]
    weight, carry = alpha * np.where(lag >= 0, (1 - alpha) ** np.maximum(lag, 0), 0.0), (1 - alpha) ** np.arange(1, step + 1)

    def smoothed(x: np.ndarray, mean: float | None) -> tuple[np.ndarray, float | None]:
        """The means of a run of one series, a block of `step` values at a time; a missing value holds the mean before it."""
        held = np.flatnonzero(~np.isnan(x))
        v, out = x[held], np.empty(len(held))
        if mean is None and len(v):
            mean = v[0]
        for a in range(0, len(v), step):
            n = len(v[a : a + step])
            out[a : a + n] = weight[:n, :n] @ v[a : a + n] + carry[:n] * mean
            mean = out[a + n - 1]
        return np.concatenate([[np.nan], out])[np.searchsorted(held, np.arange(len(x)), "right")], mean

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mean = None, None
        for batch in batches:
            x = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.float64)
            new = np.zeros(len(x), bool)
            for i in range(width):
                c = batch.column(i)
                if len(x) > 1:
                    new[1:] |= ~(pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False) | (pc.is_null(c[1:]).to_numpy(zero_copy_only=False) & pc.is_null(c[:-1]).to_numpy(zero_copy_only=False)))
            edges = [0, *np.flatnonzero(new).tolist(), len(x)]
            out = np.empty(len(x))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                key = [batch.column(i)[a].as_py() for i in range(width)]
                if key != now:
                    now, mean = key, None
                before = mean
                out[a:b], mean = smoothed(x[a:b], mean)
                if before is not None:
                    out[a:b] = np.where(np.isnan(out[a:b]), before, out[a:b])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64(), from_pandas=True)], names=schema.names)

    rows = df.select(*keys, *order, F.col(value).cast("double").alias("_x")).repartition(*keys).sortWithinPartitions(*keys, *order)
    return rows.mapInArrow(each, schema)


def rolling_median(df: DataFrame, keys: list[str], time: str, value: str, width: int) -> DataFrame:
    """Adds rolling: the median over (t - width, t]. Ranges are closed, so the lower end moves up by one unit."""
    w = Window.partitionBy(*keys).orderBy(time).rangeBetween(-width + 1, 0)
    return df.withColumn("rolling", F.percentile(value, 0.5).over(w))


def causal_moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return df.withColumn("smooth", F.avg(value).over(w))


def first_sustained(df: DataFrame, keys: list[str], order: list[str], time: str, above: Column, persist: int) -> DataFrame:
    """keys and at: the end of the hold of the first crossing that lasts `persist`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("_a", above).withColumn("_isle", F.row_number().over(w) - F.sum(F.col("_a").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_a")
    runs = x.groupBy(*keys, "_isle").agg(F.min(time).alias("a"), F.max(time).alias("b")).where(F.col("b") - F.col("a") >= persist)
    return runs.groupBy(*keys).agg((F.min("a") + persist).alias("at"))


def mode_switch_count(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.where(F.col(state).isNotNull()).withColumn("_p", F.lag(state).over(w))
    return x.groupBy(*keys).agg(F.sum((F.col(state) != F.col("_p")).cast("int")).cast("long").alias("switches"))


def majority_vote(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The most frequent label of each group; the smallest on a tie."""
    c = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("label"))).alias("x")).select(*keys, F.col("x.label").alias("label"))


def held_cusum(df: DataFrame, keys: list[str], order: list[str], time: str, excess: Column, above: Column, hold: int, k: float = 0.5) -> DataFrame:
    """Rows above, with score: their CUSUM inside the crossing, 0 until it has held; it begins anew after a recovery."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_o", F.coalesce(above, F.lit(False))).withColumn("_e", excess)
    d = d.withColumn("_isle", F.row_number().over(w) - F.sum(F.col("_o").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_o")
    run = Window.partitionBy(*keys, "_isle").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    c = d.withColumn("_p", F.sum(F.col("_e") - k).over(run)).withColumn("_held", F.col(time) - F.min(time).over(run))
    return c.withColumn("score", F.when(F.col("_held") >= hold, F.col("_p") - F.least(F.lit(0.0), F.min("_p").over(run))).otherwise(F.lit(0.0))).drop("_o", "_e", "_isle", "_p", "_held")


def block_extrema(df: DataFrame, keys: list[str], order: list[str], value: str, counts: tuple[int, ...] = (5, 10, 20, 50, 100, 200)) -> DataFrame:
    """keys, blocks, mean_extent: the mean of maximum less minimum over so many equal blocks in a row; what is left at the end isn't used. Series shorter than a count have no row for it."""
    w = Window.partitionBy(*keys)
    p = df.select(*keys, F.col(value).alias("_v"), (F.row_number().over(w.orderBy(*order)) - 1).alias("_p"), F.count(F.lit(1)).over(w).alias("_n"))
    p = p.withColumn("blocks", F.explode(F.array(*[F.lit(c) for c in counts]))).withColumn("_len", F.floor(F.col("_n") / F.col("blocks")))
    p = p.where(F.col("_len") > 0).withColumn("_b", F.floor(F.col("_p") / F.col("_len"))).where(F.col("_b") < F.col("blocks"))
    return p.groupBy(*keys, "blocks", "_b").agg((F.max("_v") - F.min("_v")).alias("_x")).groupBy(*keys, "blocks").agg(F.avg("_x").alias("mean_extent"))


def degenerate_feature(df: DataFrame, case: str, value: str, levels: int = 3) -> DataFrame:
    """One row: cases, the share of them with at most so many distinct values, and whether that is half or more."""
    d = df.groupBy(case).agg(F.countDistinct(value).alias("k"))
    return d.agg(F.count(F.lit(1)).alias("cases"), F.avg((F.col("k") <= levels).cast("double")).alias("degenerate_share")).withColumn("degenerate", F.col("degenerate_share") >= 0.5)


def peer_delta(df: DataFrame, group: list[str], value: str, by: str = "mean") -> DataFrame:
    """Adds peer_delta: the value less the mean or median of the others of its group; 0 without others. For groups of a few peers at one time."""
    w = Window.partitionBy(*group)
    if by == "mean":
        n = F.count(value).over(w) - 1
        return df.withColumn("peer_delta", F.when(n > 0, F.col(value) - (F.sum(value).over(w) - F.col(value)) / n).otherwise(F.lit(0.0)))
    place = F.sum(F.when(F.col(value).isNotNull(), 1).otherwise(0)).over(w.orderBy(F.col(value).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)) - 1
    x = df.withColumn("_at", place).withColumn("_m", F.count(value).over(w) - 1)
    low, high = F.floor((F.col("_m") - 1) / 2), F.floor(F.col("_m") / 2)  # places of the middle of the others, counted without this one
    held = {f"_{n}{k}": F.max(F.when(F.col("_at") == p + k, F.col(value))).over(w) for n, p in (("a", low), ("b", high)) for k in (0, 1)}
    x = x.withColumns(held)
    mid = (F.when(low >= F.col("_at"), F.col("_a1")).otherwise(F.col("_a0")) + F.when(high >= F.col("_at"), F.col("_b1")).otherwise(F.col("_b0"))) / 2
    return x.withColumn("peer_delta", F.when(F.col("_m") > 0, F.col(value) - mid).otherwise(F.lit(0.0))).drop("_at", "_m", *held)


def alarm_levels(df: DataFrame, keys: list[str], order: list[str], excess: Column, absolute: Column, warm: float, often: int, hot: float, limit: float) -> DataFrame:
    """Rows at which a series reaches a new greatest level: 1 excess over warm, 2 at its `often`-th time, 3 excess over hot, 4 absolute over the limit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("_e", excess).withColumn("_n", F.sum((F.col("_e") > warm).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    level = F.when(absolute > limit, 4).when(F.col("_e") > hot, 3).when((F.col("_e") > warm) & (F.col("_n") >= often), 2).when(F.col("_e") > warm, 1).otherwise(0)
    x = x.withColumn("level", level).withColumn("_top", F.coalesce(F.max("level").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return x.where(F.col("level") > F.col("_top")).drop("_e", "_n", "_top")


def stress_stats(df: DataFrame, keys: list[str], order: list[str], value: str, levels: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """keys, spreads, moments and steps of a record, and up_<c>: how often it rises through median + c deviations, 1 at least. NULLs are left out."""
    x = df.where(F.col(value).isNotNull()).withColumn("_p", F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    step, q = F.col(value) - F.col("_p"), F.percentile(value, [0.005, 0.01, 0.5, 0.99, 0.995])
    g = x.groupBy(*keys).agg(
        q.alias("_q"), F.max(value).alias("_b"), F.min(value).alias("_a"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.coalesce(F.skewness(value), F.lit(0.0)).alias("skew"),
        F.coalesce(F.kurtosis(value) + 3, F.lit(0.0)).alias("kurtosis"), F.coalesce(F.avg(F.abs(step)), F.lit(0.0)).alias("roughness"), F.coalesce(F.stddev_samp(step), F.lit(0.0)).alias("diff_std"),
    )
    s = g.select(*keys, (F.col("_b") - F.col("_a")).alias("p2p"), (F.col("_b") - F.col("_q")[2]).alias("max_dev"), (F.col("_q")[2] - F.col("_a")).alias("min_dev"), "std", "skew", "kurtosis", "roughness", "diff_std",
                 (F.col("_q")[3] - F.col("_q")[1]).alias("p99_p01"), (F.col("_q")[4] - F.col("_q")[0]).alias("p995_p005"), F.col("_q")[2].alias("_m"))
    at = [F.col("_m") + c * F.col("std") for c in levels]
    rises = [F.greatest(F.sum(((F.col("_p") < a) & (F.col(value) >= a)).cast("long")), F.lit(1)).alias(f"up_{c:g}") for c, a in zip(levels, at, strict=True)]
    ups = x.join(s.select(*keys, "_m", "std"), keys).groupBy(*keys).agg(*[F.coalesce(r, F.lit(1)).alias(f"up_{c:g}") for c, r in zip(levels, rises, strict=True)])
    return s.drop("_m").join(ups, keys)


def side_contrast(df: DataFrame, keys: list[str], side: str, value: str, sides: tuple[str, str] = ("I", "II")) -> DataFrame:
    """keys, median, 90 % quantile and maximum of each side, and contrast: the first side's median less the second's."""
    of = [F.when(F.col(side) == s, F.col(value)) for s in sides]
    g = df.groupBy(*keys).agg(*[f(v).alias(f"{s}_{n}") for s, v in zip(sides, of, strict=True) for n, f in (("median", lambda v: F.percentile(v, 0.5)), ("p90", lambda v: F.percentile(v, 0.9)), ("max", F.max))])
    return g.withColumn("contrast", F.col(f"{sides[0]}_median") - F.col(f"{sides[1]}_median"))


def implicated_side(df: DataFrame, keys: list[str], side: str, box: str, value: str, sides: tuple[str, str] = ("I", "II"), top: int = 3) -> DataFrame:
    """The boxes of greatest value on each record's worse side (the first unless the contrast is negative), with rank; at most `top`."""
    c = side_contrast(df, keys, side, value, sides).select(*keys, F.when(F.col("contrast") < 0, sides[1]).otherwise(sides[0]).alias("worse"), "contrast")
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), box)
    return df.join(c, keys).where(F.col(side) == F.col("worse")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def fold_baseline(df: DataFrame, train: DataFrame, op: str, value: str, name: str = "*") -> DataFrame:
    """Adds rel (value by centre) and z by the training rows' median and 1.4826 MAD of the same operation; an operation without training rows takes that of all.

    Where the MAD is 0 the scale is 5 % of the centre, and 1 where that is 0 too; rel is NULL for a centre of 0.
    """
    x = train.where(F.col(value).isNotNull()).select(F.explode(F.array(F.col(op).cast("string"), F.lit(name))).alias("_op"), F.col(value).alias("_v")).where("_op is not null")
    c = x.groupBy("_op").agg(F.percentile("_v", 0.5).alias("_c"))
    s = x.join(c, "_op").groupBy("_op", "_c").agg((1.4826 * F.percentile(F.abs(F.col("_v") - F.col("_c")), 0.5)).alias("_m"))
    s = s.select("_op", "_c", F.when(F.col("_m") > 0, F.col("_m")).when(F.col("_c") != 0, F.abs("_c") * 0.05).otherwise(F.lit(1.0)).alias("_s"))
    every = s.where(F.col("_op") == name).select(F.col("_c").alias("_c0"), F.col("_s").alias("_s0"))  # one row
    y = df.join(s.where(F.col("_op") != name), df[op].cast("string") == F.col("_op"), "left").join(F.broadcast(every), how="left")
    centre, scale = F.coalesce("_c", "_c0"), F.coalesce("_s", "_s0")
    return y.select(*df.columns, (F.col(value) / F.nullif(centre, F.lit(0.0))).alias("rel"), ((F.col(value) - centre) / scale).alias("z"))
