"""Schema enforcement and data checks: each check is one pass that returns rows, not an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coerce_table(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Columns cast to the declared types in the declared order; meta_ columns follow unchanged; a missing one is an error."""
    if missing := [c for c in schema if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in schema.items()], *[c for c in df.columns if c.startswith("meta_")])


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n) for all rules in one aggregation."""
    counts = df.agg(*[F.count(F.when(bad, 1)).alias(name) for name, bad in rules.items()])
    return counts.unpivot([], list(rules), "rule", "n")


def feature_columns(columns: list[str], keys: set[str], labels: set[str]) -> list[str]:
    return [c for c in columns if c not in keys and c not in labels and not c.startswith("meta_")]


def dataset_summary(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("n_values"), F.round(F.avg(F.col(value).isNull().cast("double")), 6).alias("null_share"), F.min(time).alias("t_min"), F.max(time).alias("t_max")
    )


def complete_units(runs: DataFrame, picked: DataFrame, unit: str) -> DataFrame:
    """All runs of the units of the picked ones."""
    return runs.join(picked.select(unit).distinct(), unit, "left_semi")


def prediction_table_check(given: DataFrame, truth: DataFrame, labels: list[str]) -> DataFrame:
    """(error, n): ids missing or unknown or duplicate, labels outside the vocabulary. One full join of id counts."""
    g = given.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.coalesce(F.col("label").isin(labels), F.lit(False)), 1)).alias("odd"))
    j = g.join(truth.select(F.col("id").alias("t_id")).distinct(), F.col("id") == F.col("t_id"), "full_outer")
    errors = {"missing": F.col("id").isNull().cast("long"), "unknown": F.col("t_id").isNull().cast("long"), "duplicate": F.coalesce((F.col("n") > 1).cast("long"), F.lit(0)), "label": F.coalesce("odd", F.lit(0))}
    return j.agg(*[F.sum(c).alias(e) for e, c in errors.items()]).unpivot([], list(errors), "error", "n")


def column_dropout(df: DataFrame, off: list[str], optional: set[str]) -> DataFrame:
    if wrong := [c for c in off if c not in optional]:
        raise ValueError(f"not optional: {wrong}")
    return df.drop(*off)
