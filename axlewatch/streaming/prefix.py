"""What is known of a recording so far: damage and speed on a growing prefix, from one small state a series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from axlewatch.operators.fatigue import count_cycles

DAMAGE_OUT = "component_id long, event_id long, cycles double, damage double"
DAMAGE_STATE = "stack array<double>, last double, closed double, damage double"
SPEED_OUT = "component_id long, event_id long, edges long, speed double, ready boolean"
SPEED_STATE = "first long, t long, high boolean, edges long"


class PrefixDamage:
    """Rainflow on a growing record: the open stack of turning points, the last sample, and what closed cycles have done."""

    def __init__(self, exponent: float, constant: float, stack: list[float] | None = None, last: float | None = None, closed: float = 0.0, damage: float = 0.0):
        self.exponent, self.constant = exponent, constant
        self.stack, self.last, self.closed, self.damage = list(stack or []), last, closed, damage

    def harm(self, size: float) -> float:
        return (size / 2) ** self.exponent / self.constant

    def take(self, x: float | None) -> tuple[float, float]:
        """(cycles, damage) of the record up to this sample, its last sample being an end and what is left open counting half. Missing samples change nothing."""
        if x is not None and x == x and x != self.last:
            turned = self.last is None or not self.stack or (self.last - self.stack[-1]) * (x - self.last) < 0
            if self.last is not None and turned:
                for size, _ in count_cycles(self.stack, self.last):
                    self.closed, self.damage = self.closed + 1, self.damage + self.harm(size)
            self.last = x
        if self.last is None:
            return 0.0, 0.0
        stack = list(self.stack)
        cycles, damage = self.closed, self.damage
        for size, _ in count_cycles(stack, self.last):
            cycles, damage = cycles + 1, damage + self.harm(size)
        half = [abs(b - a) for a, b in zip(stack, stack[1:])]
        return cycles + len(half) / 2, damage + sum(self.harm(h) for h in half) / 2


def ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["t", "event_id"])


def stream_prefix_damage(stream: DataFrame, exponent: float, constant: float) -> DataFrame:
    """Rows (component_id, event_id, t, value) -> cycles and damage of the component's record up to each row. Rows of a micro-batch are taken in order of (t, event_id); the state is the open stack."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = PrefixDamage(exponent, constant, *(state.get if state.exists else ()))
        rows = ordered(frames)
        out = [(key[0], i, *now.take(None if pd.isna(x) else float(x))) for i, x in zip(rows["event_id"], rows["value"], strict=True)]
        state.update((now.stack, now.last, now.closed, now.damage))
        yield pd.DataFrame(out, columns=["component_id", "event_id", "cycles", "damage"])

    return stream.groupBy("component_id").applyInPandasWithState(step, DAMAGE_OUT, DAMAGE_STATE, "append", GroupStateTimeout.NoTimeout)


def stream_prefix_speed(stream: DataFrame, threshold: float, distance: float, least: int) -> DataFrame:
    """Rows (component_id, event_id, t in microseconds, value) -> edges of the pulse (value over the threshold) so far, the mean speed they give (`distance` for two edges, a second) and whether there are `least` edges yet."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, _, high, edges = state.get if state.exists else (None, None, None, 0)
        out, t = [], None
        rows = ordered(frames)
        for i, t, x in zip(rows["event_id"], rows["t"], rows["value"], strict=True):
            t, now = int(t), bool(x > threshold)
            first = t if first is None else first
            edges, high = edges + (high is not None and now != high), now
            out.append((key[0], i, edges, edges / 2 * distance / ((t - first) / 1e6) if t > first else None, edges >= least))
        state.update((first, t, high, edges))
        yield pd.DataFrame(out, columns=["component_id", "event_id", "edges", "speed", "ready"]).astype({"speed": "float64"})

    return stream.groupBy("component_id").applyInPandasWithState(step, SPEED_OUT, SPEED_STATE, "append", GroupStateTimeout.NoTimeout)
