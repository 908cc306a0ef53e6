"""The given tables as the engine's tables: telemetry, fault log, cycle tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
SECOND_US = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, component_id, train_id, signal, t (epoch microseconds), value. NaN means a dropout and becomes NULL."""
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("user_id").alias("component_id"), (F.col("user_id") % 10).alias("train_id"), F.col("event_type").alias("signal"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.when(~F.isnan("value"), F.col("value")).alias("value"), "props",
    )


def fault_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fault_id, component_id, train_id, onset, failure (two days later): the errors above 200."""
    return telemetry(spark, sf_dir).where("signal = 'error' and value > 200").select(F.col("event_id").alias("fault_id"), "component_id", "train_id", F.col("t").alias("onset"), (F.col("t") + 2 * DAY_US).alias("failure"))


#: The same in SQL, as common table expressions.
TEL = "tel as (select event_id, user_id as component_id, user_id % 10 as train_id, event_type as signal, epoch_us(ts) as t, value, props from events)"
FLT = "flt as (select event_id as fault_id, component_id, train_id, t as onset, t + 172800000000 as failure from tel where signal = 'error' and value > 200)"
