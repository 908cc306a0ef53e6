"""Tests of drift that carry a state from reading to reading."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: count, mean, sum up, sum down, least sum up, greatest sum down, evidence of detections so far, greatest evidence, whether the last reading was a detection
START = (0, 0.0, 0.0, 0.0, math.inf, -1.0, 0.0, 0.0, False)


def page_hinkley_step(state: tuple, x: float | None, threshold: float, delta: float, alpha: float, warm: int) -> tuple:
    """The state after one reading; a NULL or NaN counts as the mean. The sums begin anew after a detection."""
    n, mean, up, down, low, high, base, top, drift = state
    if drift:
        n, mean, up, down, low, high = START[:6]
    x = mean if x is None or not math.isfinite(x) else x
    n += 1
    mean += (x - mean) / n
    up = alpha * up + (x - mean) - delta
    down = alpha * down + (x - mean) + delta
    low, high = min(low, up), max(high, down)
    now = max(up - low, high - down) if n >= warm else 0.0
    drift = now > threshold
    return n, mean, up, down, low, high, base + threshold if drift else base, max(top, base + now), drift


def page_hinkley(df: DataFrame, keys: list[str], order: list[str], value: str, threshold: float = 50.0, delta: float = 0.005, alpha: float = 1 - 1e-4, warm: int = 30) -> DataFrame:
    """keys, order columns, evidence (never falls), drift: a row per reading. Rows stream in order through the task of their series, which holds one state."""
    schema = T.StructType([*[df.schema[c] for c in (*keys, *order)], T.StructField("evidence", T.DoubleType()), T.StructField("drift", T.BooleanType())])
    width = len(keys)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, START
        for batch in batches:
            evidence, drift = [], []
            for *key, x in zip(*(batch.column(i).to_pylist() for i in (*range(width), batch.num_columns - 1)), strict=True):
                if key != now:
                    now, state = key, START
                state = page_hinkley_step(state, x, threshold, delta, alpha, warm)
                evidence.append(state[7]), drift.append(state[8])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(evidence, pa.float64()), pa.array(drift, pa.bool_())], names=schema.names)

    rows = df.select(*keys, *order, df[value].cast("double").alias("_x")).repartition(*keys).sortWithinPartitions(*keys, *order)
    return rows.mapInArrow(each, schema)
