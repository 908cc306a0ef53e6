"""Splits of rows into training, validation and test parts, as columns; random choices are hashes of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axlewatch.operators.ranked import order_statistics, running_sums


def temporal_split(df: DataFrame, start: str, end: str, val_from: Column, test_from: Column) -> DataFrame:
    """Adds part. A row whose support straddles a cut belongs to none; a NULL time is dropped."""
    part = F.when(F.col(end) < val_from, "train").when((F.col(start) >= val_from) & (F.col(end) < test_from), "val").when(F.col(start) >= test_from, "test").otherwise("none")
    return df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("part", part)


def peer_atomic_support(df: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    w = Window.partitionBy(*group)
    return df.withColumn(start, F.min(start).over(w)).withColumn(end, F.max(end).over(w))


def fraction_split(df: DataFrame, start: str, end: str, val: float = 0.6, test: float = 0.8) -> DataFrame:
    cuts = order_statistics(df, start, {"_v": val, "_t": test})
    return temporal_split(df.join(F.broadcast(cuts)), start, end, F.col("_v"), F.col("_t")).drop("_v", "_t")


def leave_one_group_out(df: DataFrame, group: str, most: int = 1000) -> DataFrame:
    """Rows repeated for each fold: test in the fold of their own group, else train. For at most `most` groups, which is checked."""
    folds = df.select(F.col(group).alias("fold")).distinct()
    if (n := folds.limit(most + 1).count()) > most:
        raise ValueError(f"leave_one_group_out: over {n - 1} groups; a fold for each would repeat every row as often")
    return df.join(F.broadcast(folds)).withColumn("part", F.when(F.col("fold") == F.col(group), "test").otherwise("train"))


def group_holdout(df: DataFrame, group: str, seed: str, n_test: int, n_val: int) -> DataFrame:
    """Whole groups by the order of md5(seed, group): the first to test, the next to validation."""
    g = df.select(group).distinct().withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(group).cast("string"))))
    g = running_sums(g, ["_h", group], {"_r": F.lit(1)}).drop("_h")
    g = g.withColumn("part", F.when(F.col("_r") <= n_test, "test").when(F.col("_r") <= n_test + n_val, "val").otherwise("train")).drop("_r")
    return df.join(g, group)


def rank_of_group_split(df: DataFrame, group: str, val_from: int, test_from: int) -> DataFrame:
    g = running_sums(df.select(group).distinct(), [group], {"_r": F.lit(1)}).select(group, (F.col("_r") - 1).alias("rank"))
    return df.join(g, group).withColumn("part", F.when(F.col("rank") >= test_from, "test").when(F.col("rank") >= val_from, "val").otherwise("train"))


def group_kfold(df: DataFrame, group: str, k: int) -> DataFrame:
    """Adds fold, 0 to k - 1: whole groups, in the order of falling size dealt to the folds to and fro, so that folds have like sizes. NULL is a group."""
    sizes = df.groupBy(group).agg((-F.count(F.lit(1))).alias("_n"))
    r = (F.col("_r") - 1) % (2 * k)
    dealt = running_sums(sizes, ["_n", group], {"_r": F.lit(1)}).select(F.col(group).alias("_g"), F.when(r < k, r).otherwise(2 * k - 1 - r).cast("int").alias("fold"))
    return df.join(dealt, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def repeated_kfold(df: DataFrame, key: str, k: int, repeats: int) -> DataFrame:
    """Rows repeated for each of `repeats` (a parameter, not data) with repeat and fold: the rank by md5(repeat-key), modulo k."""
    x = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_h", F.md5(F.concat_ws("-", F.col("repeat").cast("string"), F.col(key).cast("string"))))
    return running_sums(x, ["_h", key], {"_r": F.lit(1)}, ["repeat"]).withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_h", "_r")


def repeat_errors(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: mean and deviation (sample) over repeats of each repeat's mean absolute error."""
    e = df.groupBy("repeat").agg(F.avg(F.abs(F.col(truth) - F.col(guess))).alias("e"))
    return e.agg(F.avg("e").alias("error"), F.stddev_samp("e").alias("deviation"))


def subwindow_slices(df: DataFrame, keys: list[str], pos: str, n: str) -> DataFrame:
    """Rows of a recording of n (positions from 0) once for each of three slices of half its length that overlap by half, with slice 0 to 2."""
    half, quarter = F.floor(F.col(n) / 2), F.floor(F.col(n) / 4)
    inside = [F.when((F.col(pos) >= i * quarter) & (F.col(pos) < i * quarter + half), F.lit(i)) for i in range(3)]
    return df.withColumn("slice", F.explode(F.array_compact(F.array(*inside))))
