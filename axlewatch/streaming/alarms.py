"""Alarm episodes of a stream: the rule of operators.episodes on rows that come in any order within the watermark's delay.

Rows wait in the state until the watermark has passed them and are then taken in order of (t, event_id), so late rows and
ties give what the batch operator gives. An event-time timer wakes a series when its oldest waiting row is final or when
the merge gap behind an open episode has passed, whichever is first; only then is the episode given. The state of a series
is one struct, with the waiting rows (bounded by the delay) packed in one field, so a call reads and writes it once,
however many rows wait.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "component_id long, episode long, t_start long, t_end long, n_rows long, peak double"
#: a waiting row, as packed in the state; a missing score is NaN
WAITING = np.dtype([("t", "<i8"), ("event_id", "<i8"), ("score", "<f8"), ("above", "?")])
#: last row's time and whether it was over; the run so far; the open episode; the rows behind it; number of the next episode
FIELDS = ["last", "run_n", "run_a", "run_peak", "start", "end", "n", "peak", "tail_n", "tail_peak", "number"]
NOW = "last long, run_n long, run_a long, run_peak double, start long, end long, n long, peak double, tail_n long, tail_peak double, number long, waiting binary"
NOTHING = dict.fromkeys(FIELDS) | {"run_n": 0, "tail_n": 0, "number": 0}


def higher(a: float | None, b: float | None) -> float | None:
    return b if a is None else a if b is None else max(a, b)


class EpisodeRule:
    """The rule for one series, row by row; times in microseconds."""

    def __init__(self, k: int, merge_gap: int, max_step: int):
        self.k, self.merge_gap, self.max_step = k, merge_gap, max_step

    def close(self, s: dict) -> tuple:
        row = (s["number"], s["start"], s["end"], s["n"], s["peak"])
        s.update(start=None, end=None, n=None, peak=None, tail_n=0, tail_peak=None, number=s["number"] + 1)
        return row

    def take(self, s: dict, t: int, score: float | None, above: bool) -> tuple | None:
        """Moves the state on by one row; an episode that this ends."""
        given = None
        if not above or s["last"] is not None and t - s["last"] > self.max_step:
            s["run_n"] = 0
        if above:
            if not s["run_n"]:
                s["run_a"], s["run_peak"] = t, None
            s["run_n"] += 1
            s["run_peak"] = higher(s["run_peak"], score)
        s["last"] = t
        if s["start"] is not None:
            s["tail_n"] += 1
            s["tail_peak"] = higher(s["tail_peak"], score)
        if above and s["run_n"] >= self.k:
            if s["start"] is not None and s["run_a"] - s["end"] < self.merge_gap:
                s.update(end=t, n=s["n"] + s["tail_n"], peak=higher(s["peak"], s["tail_peak"]), tail_n=0, tail_peak=None)
            else:
                given = self.close(s) if s["start"] is not None else None
                s.update(start=s["run_a"], end=t, n=s["run_n"], peak=s["run_peak"], tail_n=0, tail_peak=None)
        return given

    def passed(self, s: dict, now: int) -> tuple[tuple | None, int | None]:
        """(the open episode if no row after `now` can still join it, when to look again)."""
        if s["start"] is None:
            return None, None
        if 0 < s["run_n"] < self.k and s["run_a"] - s["end"] < self.merge_gap and now - s["last"] <= self.max_step:
            return None, s["last"] + self.max_step + 1
        due = s["end"] + self.merge_gap
        if s["run_n"] >= self.k:
            due = max(due, s["last"] + self.max_step + 1)  # the run itself may go on
        return (self.close(s), None) if now >= due else (None, due)


def packed(df: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(df), WAITING)
    for c, kind in (("t", "int64"), ("event_id", "int64"), ("score", "float64"), ("above", "bool")):
        out[c] = df[c].astype(kind)
    return out


class Episodes(StatefulProcessor):
    def __init__(self, k: int, merge_gap: int, max_step: int):
        self.rule = EpisodeRule(k, merge_gap, max_step)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", NOW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self.move(key, timerValues.getCurrentWatermarkInMs() * 1000, [packed(df) for df in rows])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.move(key, timerValues.getCurrentWatermarkInMs() * 1000, [])

    def move(self, key: tuple, passed: int, new: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        now = self.now.get()
        s = dict(NOTHING) if now is None else dict(zip(FIELDS, now[:-1], strict=True))
        held = np.concatenate([np.frombuffer(b"" if now is None else bytes(now[-1]), WAITING), *new])
        held = held[np.lexsort((held["event_id"], held["t"]))]
        n = int(np.searchsorted(held["t"], passed, side="right"))
        rest = held[n:]
        given = [e for t, _, score, above in held[:n].tolist() if (e := self.rule.take(s, t, score if score == score else None, above))]
        ended, again = self.rule.passed(s, passed)
        given += [ended] if ended else []
        self.now.update((*(s[f] for f in FIELDS), rest.tobytes()))
        at = min((x for x in (int(rest["t"][0]) if len(rest) else None, again) if x is not None), default=None)
        if at is not None:  # the call that it brings sets the next one
            self.handle.registerTimer(max(-(-at // 1000), passed // 1000 + 1))
        if given:
            yield pd.DataFrame([(key[0], *e) for e in given], columns=["component_id", "episode", "t_start", "t_end", "n_rows", "peak"]).astype({"peak": "float64"})

    def close(self) -> None:
        pass


def stream_episodes(stream: DataFrame, threshold: float, k: int, merge_gap: int, max_step: int, late: str = "1 day") -> DataFrame:
    """Rows (ts, component_id, event_id, t in microseconds, value) -> component_id, episode, t_start, t_end, n_rows, peak of episodes that are over.

    The session needs the RocksDB state store, which keeps timers. A missing value is not over the threshold.
    """
    rows = stream.withWatermark("ts", late).select("ts", "component_id", "event_id", "t", F.col("value").alias("score"), F.coalesce(F.col("value") > threshold, F.lit(False)).alias("above"))
    return rows.groupBy("component_id").transformWithStateInPandas(Episodes(k, merge_gap, max_step), OUT, "Append", "EventTime")
