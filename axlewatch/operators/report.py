"""Tables that sum up runs: scores, choices, pivots, frames of a moment, signals of an alarm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGNALS = "array<struct<signal:string,z:double,value:double>>"


def mape_score(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: 1 less the mean absolute relative error, 0 at least; rows of truth 0 don't count."""
    return df.where(F.col(truth) != 0).agg(F.greatest(F.lit(0.0), 1 - F.avg(F.abs(F.col(guess) - F.col(truth)) / F.abs(truth))).alias("mape_score"))


def rank_decay(df: DataFrame, case: list[str], score: str, name: str, is_true: Column) -> DataFrame:
    """One row: the mean over cases of (n - r + 1) / n, r being the rank by descending score (then name) of the first true row."""
    by = Window.partitionBy(*case)
    x = df.select(*case, is_true.alias("_y"), F.count(F.lit(1)).over(by).alias("_n"), F.row_number().over(by.orderBy(F.col(score).desc(), name)).alias("_r"))
    per = x.where("_y").groupBy(*case).agg(((F.first("_n") - F.min("_r") + 1) / F.first("_n")).alias("d"))
    return per.agg(F.avg("d").alias("rank_decay"))


def best_per_population(df: DataFrame, population: list[str], eligible: Column, metric: str, name: str) -> DataFrame:
    """The eligible row of the greatest metric of each population; the first name on a tie."""
    w = Window.partitionBy(*population).orderBy(F.col(metric).desc(), name)
    return df.where(eligible).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def ablation_pivot(df: DataFrame, model: str, axis: str, levels: list[str], metric: str) -> DataFrame:
    """A row per model; for each level of the axis the mean metric, the rows that have one, and all rows."""
    cells = [F.avg(metric).alias("mean"), F.count(metric).alias("finished"), F.count(F.lit(1)).alias("attempted")]
    return df.groupBy(model).pivot(axis, levels).agg(*cells)


def rollup(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys, n, and mean, std (sample), min and max of every feature."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{a}") for c in features for a, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])


def frame_at(states: DataFrame, unit: str, components: DataFrame, key: str) -> DataFrame:
    """A row per unit from component states (key, score, state): components, how many are crit and warn, and the greatest score."""
    names = components.select(F.col(key).alias("_k"), unit).distinct()
    j = states.join(names, F.col(key) == F.col("_k"))
    return j.groupBy(unit).agg(F.count(F.lit(1)).alias("components"), *[F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("crit", "warn")], F.max("score").alias("score"))


def top_signals_json(df: DataFrame, z: dict[str, Column], values: dict[str, Column], n: int = 5) -> DataFrame:
    """Adds top_signals: JSON of the n features of greatest |z| as {signal, z, value}; equal ones in the order given; NULL z are left out."""
    every = F.filter(F.array(*[F.struct((-F.abs(c)).alias("o"), F.lit(i).alias("i"), F.lit(k).alias("signal"), c.cast("double").alias("z"), values[k].cast("double").alias("value")) for i, (k, c) in enumerate(z.items())]), lambda x: x["z"].isNotNull())
    top = F.transform(F.slice(F.array_sort(every), 1, n), lambda x: F.struct(x["signal"].alias("signal"), x["z"].alias("z"), x["value"].alias("value")))
    return df.withColumn("top_signals", F.to_json(top))


def parse_top_signals(column: Column) -> Column:
    """The list in JSON, empty where it is NULL or can't be read."""
    return F.coalesce(F.from_json(column, SIGNALS), F.array().cast(SIGNALS))


def generalisation_gap(df: DataFrame, axes: list[str], split: str, metric: str, control: str, held: str) -> DataFrame:
    """Rows of the held-out split with generalisation_gap: the metric of the run that is equal on all axes (NULLs too) under the control split, less theirs."""
    c = df.where(F.col(split) == control).groupBy(*axes).agg(F.max(metric).alias("_c"))
    h = df.where(F.col(split) == held).alias("h")
    on = [F.col(f"h.{a}").eqNullSafe(F.col(f"c.{a}")) for a in axes]
    return h.join(c.alias("c"), on, "left").select("h.*", (F.col("_c") - F.col(metric)).alias("generalisation_gap"))


def operating_point(df: DataFrame, uncalibrated: str, silent: str, impossible: str, fabricated: str) -> DataFrame:
    """Adds eligible and op_point: runs that are calibrated, not silent (which says nothing on a fabricated timeline) and able to form episodes, and the reason."""
    u, s, i, f = (F.coalesce(F.col(c), F.lit(False)) for c in (uncalibrated, silent, impossible, fabricated))
    why = F.when(u, "uncalibrated").when(i, "episodes impossible").when(f & s, "budget n/a, silent on validation").when(f, "budget n/a").when(s, "silent").otherwise("calibrated")
    return df.withColumns({"eligible": ~u & ~(s & ~f) & ~i, "op_point": why})


def fold_aggregate(df: DataFrame, run: list[str], counts: list[str], flags: list[str], texts: list[str], means: list[str], rates: dict[str, tuple[str, str]]) -> DataFrame:
    """A row per run: counts summed, flags or-ed, texts joined (distinct, in order of text), the rest averaged, rates anew from the sums (NULL over 0)."""
    g = df.groupBy(*run).agg(
        F.count(F.lit(1)).alias("folds"), *[F.sum(c).alias(c) for c in counts], *[F.coalesce(F.max(c), F.lit(False)).alias(c) for c in flags],
        *[F.array_join(F.array_sort(F.collect_set(c)), ";").alias(c) for c in texts], *[F.avg(c).alias(c) for c in means],
    )
    return g.withColumns({k: F.col(a) / F.nullif(F.col(b), F.lit(0)) for k, (a, b) in rates.items()})


def select_per_subsystem(df: DataFrame, subsystem: str, name: str, measured: str, metrics: list[str], control: str) -> DataFrame:
    """The run of each subsystem with measured evidence before others, then the greatest first metric present, then by name; its value (`validated`), `deferred` if no run has one, and the control run's value as `floor`."""
    value = F.coalesce(*metrics)
    x = df.withColumn("validated", value)
    floor = x.where(F.col(name) == control).groupBy(subsystem).agg(F.max("validated").alias("floor"))
    w = Window.partitionBy(subsystem).orderBy(F.coalesce(F.col(measured), F.lit(False)).desc(), F.col("validated").desc_nulls_last(), name)
    best = x.where(F.col(name) != control).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return best.join(floor, subsystem, "left").select(subsystem, name, "validated", F.col("validated").isNull().alias("deferred"), "floor")


def validation_guard(df: DataFrame, part: str, key: str) -> DataFrame:
    """One row: how many rows may calibrate (part is 'val'), how many may not, and a digest of the former's keys that doesn't depend on their order: the sum of the first 32 bits of their md5."""
    val = F.coalesce(F.col(part) == "val", F.lit(False))
    bits = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return df.agg(F.coalesce(F.sum(val.cast("long")), F.lit(0)).alias("allowed"), F.coalesce(F.sum((~val).cast("long")), F.lit(0)).alias("barred"), F.coalesce(F.sum(F.when(val, bits)), F.lit(0)).alias("digest"))
