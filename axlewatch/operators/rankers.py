"""Ranks of peers inside a case, their chance floors, the choice of a rule, lifts, and a random control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axlewatch.operators.ranked import dealt


def _total(weights: dict[str, float], part) -> Column:
    """The weighted sum over features, NULL where none has a value."""
    terms = [(part(c), w) for c, w in weights.items()]
    return F.when(F.coalesce(*[t for t, _ in terms]).isNotNull(), sum((F.coalesce(t * w, F.lit(0.0)) for t, w in terms), F.lit(0.0)))


def zsum_score(df: DataFrame, case: list[str], weights: dict[str, float]) -> DataFrame:
    """Adds score: the weighted sum of (value - median) / (1.4826 MAD) inside a case; the range stands in for a MAD of 0, 1 for a range of 0."""
    mid = df.groupBy(*case).agg(*[F.expr(f"percentile({c}, 0.5)").alias(f"_m_{c}") for c in weights], *[(F.max(c) - F.min(c)).alias(f"_g_{c}") for c in weights])
    x = df.join(mid, case)
    mad = x.groupBy(*case).agg(*[F.expr(f"percentile(abs({c} - _m_{c}), 0.5) * 1.4826").alias(f"_s_{c}") for c in weights])
    x = x.join(mad, case)
    scale = lambda c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).when(F.col(f"_g_{c}") > 0, F.col(f"_g_{c}")).otherwise(1.0)
    return x.withColumn("score", _total(weights, lambda c: (F.col(c) - F.col(f"_m_{c}")) / scale(c))).drop(*[f"_{p}_{c}" for p in "mgs" for c in weights])


def borda_score(df: DataFrame, case: list[str], weights: dict[str, float]) -> DataFrame:
    """Adds score: the weighted sum of (n - r) / n, r being the rank by descending value inside a case, equal values sharing the mean of their ranks."""
    x = dealt(df, case)
    for c in weights:  # one sort for each: rank, equal values and all rows are frames of one order
        w = Window.partitionBy(*case).orderBy(F.col(c).desc_nulls_last())
        same = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
        every = F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        x = x.withColumns({f"_r_{c}": F.when(F.col(c).isNotNull(), F.rank().over(w) + (same - 1) / 2), "_n": every})
    return x.withColumn("score", _total(weights, lambda c: (F.col("_n") - F.col(f"_r_{c}")) / F.col("_n"))).drop("_n", *[f"_r_{c}" for c in weights])


def rank_case(df: DataFrame, case: list[str], score: str, ties: list[str], name: str, usable: Column) -> DataFrame:
    """Adds rank, from 1: by descending score, then ties, then name as text. Rows that aren't usable lose their score and come last."""
    x = df.withColumn(score, F.when(usable, F.col(score)))
    order = [F.col(c).desc_nulls_last() for c in (score, *ties)] + [F.col(name).cast("string").asc()]
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(*case).orderBy(*order)))


def chance_floor_rank(df: DataFrame, case: list[str], usable: Column) -> DataFrame:
    """One row: what a random order scores by rank decay, over all n members (uniform) or over the k usable ones (blind); k = 0 stands for n."""
    per = df.groupBy(*case).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(usable, 1)).alias("_k")).withColumn("k", F.when(F.col("_k") > 0, F.col("_k")).otherwise(F.col("n")))
    return per.agg(F.avg(F.expr("(n + 1) / (2 * n)")).alias("uniform"), F.avg(F.expr("(2 * n - k + 1) / (2 * n)")).alias("blind"))


def select_ranker(df: DataFrame, fold: list[str], score: str, top1: str, separation: str, features: str, place: str) -> DataFrame:
    """The best rule of each fold: score, top-1 rate, separation to six places, fewest features, place in the pool; n_tied shares score and top-1 rate."""
    keys = [F.col(score).desc(), F.col(top1).desc()]
    tied = F.count(F.lit(1)).over(Window.partitionBy(*fold, score, top1))
    w = Window.partitionBy(*fold).orderBy(*keys, F.round(separation, 6).desc(), F.col(features), F.col(place))
    return df.withColumn("n_tied", tied).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def lift_table(df: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """Adds lift_<metric> = metric / base rate for each metric: base pair, NULL where the base is NULL or not above 0."""
    return df.select("*", *[(F.col(m) / F.when(F.col(b) > 0, F.col(b))).alias(f"lift_{m}") for m, b in metrics.items()])


def random_score(df: DataFrame, key: Column, seed: int) -> DataFrame:
    """Adds score in [0, 1): 32 bits of the MD5 of key and seed, the same in every run whatever the partitions."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double")
    return df.withColumn("score", bits / 2**32)
