"""Streams: the batch operators on unbounded input, with event-time rules of their own.

The batch functions hold the semantics; a stream's output equals theirs once the watermark has passed. Stateful operators
keep one small state per series and never gather a series.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from axlewatch.operators.drift import START, page_hinkley_step

CUSUM_OUT = "component_id long, event_id long, t long, ewma double, cusum double"
DRIFT_OUT = "component_id long, event_id long, t long, evidence double, drift boolean"
DRIFT_STATE = "n long, mean double, up double, down double, low double, high double, base double, top double, drift boolean"
CUSUM_STATE = "n long, ewma double, up double, down double"


def stream_bins(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Tumbling bins of (ts, component_id, value)."""
    return stream.withWatermark("ts", late).groupBy("component_id", F.window("ts", width).alias("w")).agg(F.avg("value").alias("mean"), F.max("value").alias("peak"), F.count("value").alias("n"))


def stream_gap_sessions(stream: DataFrame, gap: str = "3 days", late: str = "1 day") -> DataFrame:
    """A session per stretch without a step above the gap."""
    return stream.withWatermark("ts", late).groupBy("component_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))


def stream_dedup(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def stream_ewma_cusum(stream: DataFrame, centre: float = 50.0, spread: float = 50.0, alpha: float = 0.2, k: float = 0.5) -> DataFrame:
    """EWMA and two-sided CUSUM carried per component; rows of a micro-batch are taken in order of (t, event_id)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, up, down = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
        out = []
        for event_id, t, value in zip(rows["event_id"], rows["t"], rows["value"], strict=True):
            z = (value - centre) / spread
            mean = value if n == 0 else (1 - alpha) * mean + alpha * value
            up, down, n = max(0.0, up + z - k), max(0.0, down - z - k), n + 1
            out.append((key[0], event_id, t, mean, max(up, down)))
        state.update((n, mean, up, down))
        yield pd.DataFrame(out, columns=["component_id", "event_id", "t", "ewma", "cusum"])

    return stream.groupBy("component_id").applyInPandasWithState(step, CUSUM_OUT, CUSUM_STATE, "append", GroupStateTimeout.NoTimeout)


def stream_page_hinkley(stream: DataFrame, threshold: float = 50.0, delta: float = 0.005, alpha: float = 1 - 1e-4, warm: int = 30) -> DataFrame:
    """The drift test carried per component; rows of a micro-batch are taken in order of (t, event_id)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else START
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
        out = []
        for event_id, t, value in zip(rows["event_id"], rows["t"], rows["value"], strict=True):
            now = page_hinkley_step(now, value, threshold, delta, alpha, warm)
            out.append((key[0], event_id, t, now[7], now[8]))
        state.update(now)
        yield pd.DataFrame(out, columns=["component_id", "event_id", "t", "evidence", "drift"])

    return stream.groupBy("component_id").applyInPandasWithState(step, DRIFT_OUT, DRIFT_STATE, "append", GroupStateTimeout.NoTimeout)
