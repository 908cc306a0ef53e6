"""Detectors: a fit is an aggregate to a small model table, a score is a join with it and row expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axlewatch.operators.features import cusum_two_sided, held_cusum, rolling_median
from axlewatch.operators.joins import nearest_event_distance
from axlewatch.operators.ranked import order_statistics, running_sums


def fit_ranges(train: DataFrame, features: list[str]) -> DataFrame:
    """One row: minimum, maximum, interquartile range, mean and population deviation of each feature."""
    plain = train.agg(*[f(x).alias(f"{x}_{n}") for x in features for n, f in (("lo", F.min), ("hi", F.max), ("mu", F.avg), ("sd", F.stddev_pop))])
    q = order_statistics(train.unpivot([], features, "_f", "_v"), "_v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, ["_f"])
    spread = q.agg(*[f(F.when(F.col("_f") == x, v)).alias(f"{x}_{n}") for f in (F.max,) for x in features for n, v in (("iqr", F.col("q3") - F.col("q1")), ("med", F.col("q2")))])
    return plain.join(spread)  # one row each


def sensor_range(rows: DataFrame, model: DataFrame, features: list[str]) -> DataFrame:
    """Adds score: the worst distance outside the training range, in interquartile ranges. model has one row."""
    out = [F.greatest(F.col(f"{x}_lo") - F.col(x), F.col(x) - F.col(f"{x}_hi"), F.lit(0.0)) / F.coalesce(F.nullif(F.col(f"{x}_iqr"), F.lit(0.0)), F.lit(1.0)) for x in features]
    return rows.join(F.broadcast(model)).withColumn("score", F.greatest(*out, F.lit(0.0))).select(*rows.columns, "score")


def trivial_set(rows: DataFrame, model: DataFrame, features: list[str]) -> DataFrame:
    """Adds range_share, l2 (of z scores) and max_z."""
    z = [(F.col(x) - F.col(f"{x}_mu")) / F.coalesce(F.nullif(F.col(f"{x}_sd"), F.lit(0.0)), F.lit(1.0)) for x in features]
    outside = sum(((F.col(x) < F.col(f"{x}_lo")) | (F.col(x) > F.col(f"{x}_hi"))).cast("double") for x in features) / len(features)
    l2 = F.sqrt(sum(v * v for v in z))
    return rows.join(F.broadcast(model)).withColumns({"range_share": outside, "l2": l2, "max_z": F.greatest(*[F.abs(v) for v in z])}).select(*rows.columns, "range_share", "l2", "max_z")


def fit_robust(train: DataFrame, features: list[str]) -> DataFrame:
    """feature, centre, spread: median and 1.4826 MAD (else deviation, else 1), all features in one long pass."""
    long = train.unpivot([], features, "feature", "v")
    c = order_statistics(long, "v", {"centre": 0.5}, ["feature"]).join(long.groupBy("feature").agg(F.stddev_pop("v").alias("sd")), "feature").checkpoint()
    far = long.join(F.broadcast(c), "feature").select("feature", F.abs(F.col("v") - F.col("centre")).alias("far"))  # a row per feature
    m = order_statistics(far, "far", {"mid": 0.5}, ["feature"]).join(c, "feature").withColumn("mad", 1.4826 * F.col("mid"))
    return m.select("feature", "centre", F.when(F.col("mad") > 0, F.col("mad")).when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0)).alias("spread"))


def robust_scores(rows: DataFrame, model: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys and the sorted (descending) absolute robust z of the features, as z."""
    long = rows.unpivot(keys, features, "feature", "v").join(F.broadcast(model), "feature")
    return long.groupBy(*keys).agg(F.sort_array(F.collect_list(F.abs((F.col("v") - F.col("centre")) / F.col("spread"))), asc=False).alias("z"))


def nearest(rows: DataFrame, sample: DataFrame, row_id: str, sample_id: str, vector: str, k: int = 1, most: int = 500) -> DataFrame:
    """row id and distance to its k-th nearest vector of a reference; itself excluded. The reference is the `most` rows of sample that are least in the hash of their id, so it is one bounded, broadcast row, and work is linear in rows."""
    s = sample.select(F.col(sample_id).alias("_s"), F.col(vector).alias("_v")).orderBy(F.md5(F.col("_s").cast("string")), "_s").limit(most)
    block = F.broadcast(s.agg(F.collect_list(F.struct("_s", "_v")).alias("_block")))
    d = F.transform(F.filter("_block", lambda b: b["_s"] != F.col(row_id)), lambda b: F.sqrt(F.aggregate(F.zip_with(vector, b["_v"], lambda x, y: (x - y).cast("double") * (x - y)), F.lit(0.0), lambda a, x: a + x)))
    return rows.join(block).select(row_id, F.get(F.array_sort(d), k - 1).alias("score"))


def tails(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys, feature, l and r (the -log shares of values up to and from this one) and the feature's skew: a row for each row and feature.

    Tail shares come from distinct values, counted before they are put in order, so a frequent value is one row of it.
    """
    long = rows.unpivot(keys, features, "feature", "v")
    n = long.groupBy("feature").agg(F.count("v").alias("n"), F.skewness("v").alias("skew"))
    counts = long.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("c"))
    shares = running_sums(counts, ["v"], {"l": F.col("c")}, ["feature"]).join(F.broadcast(n), "feature")  # a row per feature
    shares = shares.select("feature", "v", (-F.log(F.col("l") / F.col("n"))).alias("l"), (-F.log((F.col("n") - F.col("l") + F.col("c")) / F.col("n"))).alias("r"), "skew")
    return long.join(shares, ["feature", "v"])


def ecod(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys (of a row) and score: summed -log tail probabilities, the larger of left, right and skew-selected sums."""
    j = tails(rows, keys, features)
    return j.groupBy(*keys).agg(F.greatest(F.sum("l"), F.sum("r"), F.sum(F.when(F.col("skew") < 0, F.col("l")).otherwise(F.col("r")))).alias("score"))


def conformal(scores: DataFrame, calibration: DataFrame, score: str) -> DataFrame:
    """Adds p_alarm = 1 - (1 + #{calibration >= s}) / (1 + n), by running counts over distinct scores."""
    u = calibration.select((-F.col(score)).alias("_s"), F.lit(1).alias("_c")).unionAll(scores.select((-F.col(score)).alias("_s"), F.lit(0).alias("_c")))
    p = running_sums(u.groupBy("_s").agg(F.sum("_c").alias("_c")), ["_s"], {"_k": F.col("_c")})
    p = p.join(F.broadcast(calibration.agg(F.count(score).alias("_n")))).select("_s", (1 - (1 + F.col("_k")) / (1 + F.col("_n"))).alias("p_alarm"))  # one row of n
    return scores.join(p, -F.col(score) == F.col("_s")).drop("_s")


def window_variance(windows: DataFrame, train: DataFrame, std: str) -> DataFrame:
    """Adds score: the variance of a window as a multiple of the training windows' median variance."""
    base = order_statistics(train.select((F.col(std) * F.col(std)).alias("_v")), "_v", {"_m": 0.5})
    return windows.join(F.broadcast(base)).withColumn("score", F.col(std) * F.col(std) / F.col("_m")).drop("_m")  # one row


def squared_diff(samples: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """keys and score: the mean squared step inside a window as a multiple of the median over all windows."""
    d = samples.withColumn("_d", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(pos)))
    s = d.groupBy(*keys).agg(F.avg(F.col("_d") * F.col("_d")).alias("_m"))
    return s.join(F.broadcast(order_statistics(s, "_m", {"_b": 0.5}))).select(*keys, (F.col("_m") / F.col("_b")).alias("score"))  # one row


def l2_norm(rows: DataFrame, train: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """keys, peak and mean of the samples' lengths in standardised channels (population deviation, 1 where it is 0)."""
    model = train.agg(*[f(c).alias(f"{c}_{n}") for c in channels for n, f in (("mu", F.avg), ("sd", F.stddev_pop))])
    z = [(F.col(c) - F.col(f"{c}_mu")) / F.coalesce(F.nullif(F.col(f"{c}_sd"), F.lit(0.0)), F.lit(1.0)) for c in channels]
    x = rows.join(F.broadcast(model)).select(*keys, F.sqrt(sum(v * v for v in z)).alias("_l"))  # one row
    return x.groupBy(*keys).agg(F.max("_l").alias("peak"), F.avg("_l").alias("mean"))


def copod(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys (of a row) and score: summed over features, the greater of the skew-selected -log tail and the mean of both tails."""
    x = tails(rows, keys, features)
    return x.groupBy(*keys).agg(F.sum(F.greatest(F.when(F.col("skew") < 0, F.col("l")).when(F.col("skew") > 0, F.col("r")).otherwise(F.col("l") + F.col("r")), (F.col("l") + F.col("r")) / 2)).alias("score"))


def duty_ratio(df: DataFrame, keys: list[str], order: list[str], time: str, value: str, width: int, learn: int, hold: int, low: float = 0.05) -> DataFrame:
    """Rows whose rolling median lies below the series' own low quantile of its first `learn` units of time, with score: their held CUSUM.

    Both are compared to nine places, as what is interpolated between two readings may be off in its last bit.
    """
    begun = df.groupBy(*keys).agg(F.min(time).alias("_t0"))
    floor = df.join(begun, keys).where(F.col(time) < F.col("_t0") + learn).groupBy(*keys).agg(F.percentile(value, low).alias("_floor"))
    x = rolling_median(df, keys, time, value, width).join(floor, keys)
    return held_cusum(x, keys, order, time, F.col("_floor") - F.col("rolling"), F.round("rolling", 9) < F.round("_floor", 9), hold).drop("_floor")


def transition_mask(df: DataFrame, events: DataFrame, keys: list[str], order: list[str], time: str, z: Column, near: int) -> DataFrame:
    """Adds score: the two-sided CUSUM of z within `near` of an event of the series (events: keys and `at`), |z| elsewhere."""
    x = nearest_event_distance(cusum_two_sided(df, keys, order, z), events, keys, time, "at")
    return x.withColumn("score", F.when(F.col("distance") <= near, F.col("cusum")).otherwise(F.abs(z))).drop("cusum", "distance")
