"""All registered queries of the engine, their SQL, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from axlewatch.plans import alarms, cases, core, fatigue, files, judge, learn, models, motion, ranks, records, streams, waves  # noqa: F401  they register their queries
from axlewatch.plans.registry import ORACLES, QUERIES  # noqa: F401


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["alarm_episodes_of_components"](spark, sf_dir)
