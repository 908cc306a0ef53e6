"""Groups of like units at one time: guards, and detectors on a unit's distance from its peers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axlewatch.operators.features import peer_delta, robust_baseline


def peer_group_guards(df: DataFrame, group: list[str], declared: str, start: str, features: list[str], slack: int) -> DataFrame:
    """group and problem: a row per group whose size isn't the declared one ('size'), whose starts differ by more than slack ('start'), or with features that are equal in all of two or more members ('constant:' and their names)."""
    n = F.count(F.lit(1))
    flat = F.array_compact(F.array(*[F.when((n > 1) & (F.min(f) == F.max(f)) & (F.count(f) == n), F.lit(f)) for f in features]))
    g = df.groupBy(*group).agg(n.alias("n"), F.max(declared).alias("declared"), (F.max(start) - F.min(start)).alias("spread"), flat.alias("flat"))
    problems = F.array_compact(F.array(F.when(F.col("n") != F.col("declared"), "size"), F.when(F.col("spread") > slack, "start"), F.when(F.size("flat") > 0, F.concat(F.lit("constant:"), F.array_join("flat", ",")))))
    return g.select(*group, F.explode(problems).alias("problem"))


def peer_value_scores(df: DataFrame, train: DataFrame, series: list[str], group: list[str], value: str) -> DataFrame:
    """Adds score: |robust z| of a value's distance from its peers' mean, by the series' baseline in training rows; NULL for a series without one."""
    base = robust_baseline(peer_delta(train, group, value), series, "peer_delta")
    x = peer_delta(df, group, value).join(base, series, "left")
    return x.withColumn("score", F.abs((F.col("peer_delta") - F.col("centre")) / F.col("spread"))).drop("centre", "spread", "peer_delta")


def peer_groups(df: DataFrame, unit: str, series: str, time: str, tie: str, tolerance: int) -> DataFrame:
    """unit, time, tie, series and peer_group (the number from 1 in the unit): rows of one unit within `tolerance` of their group's first, one of each series at most.

    A unit's rows stream in order of (time, tie); what is kept is the group's first time and the series seen in it. NULL is a series like others.
    """
    columns = [unit, time, tie, series]
    schema = T.StructType([*[df.schema[c] for c in columns], T.StructField("peer_group", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, seen, n = object(), 0, set(), 0
        for batch in batches:
            out = []
            for u, t, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if u != now:
                    now, n, seen = u, 0, None
                if seen is None or t - first > tolerance or s in seen:
                    n, first, seen = n + 1, t, set()
                seen.add(s)
                out.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=schema.names)

    return df.where(F.col(time).isNotNull()).select(*columns).repartition(unit).sortWithinPartitions(unit, time, tie).mapInArrow(each, schema)
