"""Long and wide forms, windows as arrays, unions of tables with differing columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_wide(df: DataFrame, keys: list[str], signal: str, value: str, signals: list[str]) -> DataFrame:
    """One column per requested signal; an absent one is NULL. Two rows of one key and signal are an error."""
    if duplicate_keys(df.where(F.col(signal).isin(signals)), [*keys, signal]).limit(1).count():
        raise ValueError(f"rows that repeat {[*keys, signal]}")
    return df.groupBy(*keys).pivot(signal, signals).agg(F.first(value, ignorenulls=True))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def to_long(df: DataFrame, keys: list[str], signals: list[str], drop_nulls: bool = True) -> DataFrame:
    out = df.unpivot(keys, signals, "signal", "value")
    return out.where("value is not null") if drop_nulls else out


def window_matrix(windows: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """One row per window with its samples in order; a window has a fixed number of rows."""
    g = windows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(pos, value))).alias("_s"))
    return g.select(*keys, F.transform("_s", lambda x: x[value]).alias("samples"))


def expand_vector(df: DataFrame, column: str, prefix: str, n: int) -> DataFrame:
    """The first n elements as columns; what isn't finite becomes 0."""
    def at(i: int):
        x = F.get(F.col(column), i)
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x).alias(f"{prefix}_{i}")

    return df.select(*[c for c in df.columns if c != column], *[at(i) for i in range(n)])


def concat_features(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
