"""Drift by windows that adapt: ADWIN with an exponential histogram, and a two-sample test of the latest readings.

The state of a series is small: buckets whose sizes are powers of two, so the window of n readings is held in O(log n)
numbers, or the last readings themselves where the test needs a fixed number of them. Rows stream in order through the
task of their series, as the rules are sequential.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Adwin:
    """Adaptive windowing after Bifet and Gavalda: the window shrinks while two of its parts have means that differ by more than the bound.

    levels[i] holds (sum, summed squared deviations) of buckets of 2**i readings, oldest first; the oldest readings are in
    the last level.
    """

    def __init__(self, delta: float = 0.002, clock: int = 32, max_buckets: int = 5, least: int = 5, grace: int = 10):
        self.delta, self.clock, self.max_buckets, self.least, self.grace = delta, clock, max_buckets, least, grace
        self.levels: list[list[tuple[float, float]]] = [[]]
        self.width, self.total, self.spread, self.ticks = 0, 0.0, 0.0, 0

    @property
    def mean(self) -> float:
        return self.total / self.width if self.width else 0.0

    def buckets(self) -> int:
        return sum(map(len, self.levels))

    def update(self, x: float) -> bool:
        """Takes a reading; whether the window was cut."""
        self.ticks += 1
        if self.width:
            self.spread += self.width * (x - self.mean) ** 2 / (self.width + 1)
        self.width += 1
        self.total += x
        self.levels[0].append((x, 0.0))
        for i, level in enumerate(self.levels):
            if len(level) <= self.max_buckets:
                break
            (s, v), (r, w) = level[:2]
            del level[:2]
            n = 1 << i
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append((s + r, v + w + n * (s / n - r / n) ** 2 / 2))
        return self.ticks % self.clock == 0 and self.width > self.grace and self._shrink()

    def _shrink(self) -> bool:
        cut = False
        while self._differs():
            self._drop_oldest()
            cut = True
        return cut

    def _differs(self) -> bool:
        """Whether any border between buckets parts the window into two whose means differ."""
        old_n, old_sum = 0, 0.0
        log = math.log(2 * math.log(self.width) / self.delta) if self.width > 1 else 0.0
        for i in range(len(self.levels) - 1, -1, -1):
            for s, _ in self.levels[i]:
                old_n, old_sum = old_n + (1 << i), old_sum + s
                new_n = self.width - old_n
                if new_n < self.least:
                    return False
                if old_n < self.least:
                    continue
                m = 1 / (old_n - self.least + 1) + 1 / (new_n - self.least + 1)
                bound = math.sqrt(2 * m * self.spread / self.width * log) + 2 / 3 * log * m
                if abs(old_sum / old_n - (self.total - old_sum) / new_n) > bound:
                    return True
        return False

    def _drop_oldest(self) -> None:
        i = len(self.levels) - 1
        s, v = self.levels[i].pop(0)
        n = 1 << i
        self.width -= n
        self.total -= s
        if self.width:
            self.spread -= v + n * self.width * (s / n - self.mean) ** 2 / (n + self.width)
            self.spread = max(self.spread, 0.0)
        else:
            self.spread = 0.0
        while len(self.levels) > 1 and not self.levels[-1]:
            self.levels.pop()


class AdwinEvidence:
    """The distance of the adaptive mean from the healthy one, in healthy deviations, one more for each detection so far; never falls."""

    def __init__(self, centre: float, scale: float, **rules):
        self.window, self.centre, self.scale = Adwin(**rules), centre, max(abs(scale), 1e-12)
        self.warm = max(self.window.grace, self.window.least, 2)
        self.seen, self.bonus, self.top = 0, 0.0, 0.0

    def update(self, x: float | None) -> tuple[float, bool]:
        x = self.window.mean if x is None or not math.isfinite(x) else x
        drift = self.window.update(x)
        now = abs(self.window.mean - self.centre) / self.scale if self.seen >= self.warm else 0.0
        self.seen += 1
        self.top = max(self.top, self.bonus + now)
        self.bonus += drift
        return self.top, drift


def ks_p(a: np.ndarray, b: np.ndarray) -> float:
    """Asymptotic p of the two-sample test of Kolmogorov and Smirnov."""
    both = np.concatenate([a, b])
    gap = np.abs(np.searchsorted(np.sort(a), both, "right") / len(a) - np.searchsorted(np.sort(b), both, "right") / len(b)).max()
    z = gap * math.sqrt(len(a) * len(b) / (len(a) + len(b)))
    if z < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101))))


class KsEvidence:
    """-log10 p of the latest `latest` readings against as many drawn from the rest of a window, the draw seeded by series and place; never falls."""

    def __init__(self, seed: str, window: int = 100, latest: int = 30, alpha: float = 0.005):
        self.seed, self.size, self.latest, self.alpha = seed, window, latest, alpha
        self.held: list[float] = []
        self.seen, self.bonus, self.top, self.last = 0, 0.0, 0.0, 0.0

    def update(self, x: float | None) -> tuple[float, bool]:
        x = self.last if x is None or not math.isfinite(x) else x
        self.last = x
        self.held = [*self.held[-self.size + 1 :], x]
        self.seen += 1
        drift, now = False, 0.0
        if len(self.held) == self.size:
            rest = np.array(self.held[: -self.latest])
            rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{self.seed}:{self.seen}".encode()).digest()[:8], "big"))
            p = ks_p(rng.choice(rest, self.latest, replace=False), np.array(self.held[-self.latest :]))
            now, drift = -math.log10(max(p, 1e-12)), p <= self.alpha
            if drift:
                self.held = self.held[-self.latest :]
        self.top = max(self.top, self.bonus + now)
        self.bonus += drift
        return self.top, drift


def streamed(df: DataFrame, keys: list[str], order: list[str], values: list[Column], begin: Callable[[list, list], object]) -> DataFrame:
    """keys, order columns, evidence, drift. begin(key, first values) makes the state of a series; its update takes the first value of each row."""
    schema = T.StructType([*[df.schema[c] for c in (*keys, *order)], T.StructField("evidence", T.DoubleType()), T.StructField("drift", T.BooleanType())])
    width, held = len(keys), len(keys) + len(order)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            evidence, drift = [], []
            for row in zip(*(batch.column(i).to_pylist() for i in (*range(width), *range(held, batch.num_columns))), strict=True):
                if row[:width] != now:
                    now, state = row[:width], begin(list(row[:width]), list(row[width:]))
                e, d = state.update(row[width])
                evidence.append(e), drift.append(d)
            yield pa.RecordBatch.from_arrays([*batch.columns[:held], pa.array(evidence, pa.float64()), pa.array(drift, pa.bool_())], names=schema.names)

    rows = df.select(*keys, *order, *[v.cast("double").alias(f"_v{i}") for i, v in enumerate(values)]).repartition(*keys).sortWithinPartitions(*keys, *order)
    return rows.mapInArrow(each, schema)


def adwin(df: DataFrame, keys: list[str], order: list[str], value: str, centre: Column | float = 0.0, scale: Column | float = 1.0, **rules) -> DataFrame:
    """keys, order columns, evidence, drift: an adaptive window for each series. A missing reading counts as the window's mean."""
    both = [c if isinstance(c, Column) else F.lit(c) for c in (centre, scale)]
    return streamed(df, keys, order, [F.col(value), *both], lambda key, first: AdwinEvidence(first[1] or 0.0, first[2] if first[2] is not None else 1.0, **rules))


def kswin(df: DataFrame, keys: list[str], order: list[str], value: str, seed: int = 0, **rules) -> DataFrame:
    """keys, order columns, evidence, drift: the latest readings tested against those before. A missing reading counts as the one before."""
    return streamed(df, keys, order, [F.col(value)], lambda key, first: KsEvidence(f"{seed}:{key}", **rules))


def change_scores(df: DataFrame, keys: list[str], time: str, tie: str, flag: str, curve: str, tau: float) -> DataFrame:
    """Adds near (exp of minus the time since the last flagged row over tau, 0 before any), curve01 (the curve between its series' least and greatest, 0 if flat) and count01 (flags so far over all of the series)."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    up, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    hit = F.coalesce(F.col(flag), F.lit(False))
    since = F.col(time) - F.last(F.when(hit, F.col(time)), True).over(up)
    low, high = F.min(curve).over(whole), F.max(curve).over(whole)
    flags = F.sum(hit.cast("long"))
    return df.withColumns({
        "near": F.coalesce(F.exp(-since / tau), F.lit(0.0)), "curve01": F.when(high > low, (F.col(curve) - low) / (high - low)).otherwise(F.lit(0.0)),
        "count01": F.coalesce(flags.over(up) / F.nullif(flags.over(whole), F.lit(0)), F.lit(0.0)),
    })
