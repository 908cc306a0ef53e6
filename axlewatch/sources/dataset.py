"""Datasets on disk: a folder per table, partitioned by source and run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_dataset(tables: dict[str, DataFrame], path: str, by: tuple[str, ...] = ("source", "run_id")) -> None:
    """Each table as Parquet under path/name, a folder per source and run. Rows are dealt by run and, inside, by a hash, so a long run isn't one task or file."""
    for name, df in tables.items():
        spread = F.pmod(F.xxhash64(*[c for c in df.columns if c not in by]), F.lit(8))
        df.repartition(*by, spread).write.partitionBy(*by).option("compression", "zstd").parquet(f"{path}/{name}")


def read_dataset(spark: SparkSession, path: str, name: str, **only: list[str]) -> DataFrame:
    """A table, of some sources or runs only: the filters choose folders, so others aren't read."""
    df = spark.read.parquet(f"{path}/{name}")
    for column, values in only.items():
        df = df.where(F.col(column).isin(*values))
    return df
