"""The exponential histogram against a window that keeps every reading; evidence never falls; series don't mix."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from axlewatch.operators import adaptive


class Listed:
    """The same rule on a list of readings with the sizes of its buckets."""

    def __init__(self, delta, clock, most, least, grace):
        self.rule, self.xs, self.sizes, self.ticks = (delta, clock, most, least, grace), [], [], 0

    def update(self, x):
        delta, clock, most, least, grace = self.rule
        self.ticks += 1
        self.xs.append(x)
        self.sizes.append(1)
        size = 1
        while self.sizes.count(size) > most:
            i = self.sizes.index(size)
            self.sizes[i : i + 2] = [2 * size]
            size *= 2
        cut = False
        if self.ticks % clock == 0 and len(self.xs) > grace:
            while self.differs(delta, least):
                del self.xs[: self.sizes.pop(0)]
                cut = True
        return cut

    def differs(self, delta, least):
        n, log = len(self.xs), math.log(2 * math.log(len(self.xs)) / delta)
        var, k = float(np.var(self.xs)), 0
        for size in self.sizes:
            k += size
            if k < least or n - k < least:
                continue
            m = 1 / (k - least + 1) + 1 / (n - k - least + 1)
            if abs(np.mean(self.xs[:k]) - np.mean(self.xs[k:])) > math.sqrt(2 * m * var * log) + 2 / 3 * log * m:
                return True
        return False


@pytest.mark.parametrize("seed", range(4))
def test_detections_and_means_equal_those_of_a_list(seed):
    rng = np.random.default_rng(seed)
    xs = np.concatenate([rng.normal(0, 1, 300), rng.normal(3, 1, 200), rng.normal(-1, 0.2, 400)])
    a, b = adaptive.Adwin(clock=8), Listed(0.002, 8, 5, 5, 10)
    hits = 0
    for x in xs.tolist():
        hit = a.update(x)
        assert hit == b.update(x)
        assert a.width == len(b.xs) and math.isclose(a.mean, float(np.mean(b.xs)), abs_tol=1e-9)
        assert math.isclose(a.spread, float(np.var(b.xs)) * len(b.xs), rel_tol=1e-6, abs_tol=1e-6)
        hits += hit
    assert hits >= 2


def test_memory_is_logarithmic():
    a = adaptive.Adwin()
    for i in range(20_000):
        a.update(math.sin(i))
    assert a.width == 20_000 and a.buckets() <= 5 * math.ceil(math.log2(20_000)) + 5


def test_p_of_equal_and_of_separate_samples():
    a = np.arange(30.0)
    assert adaptive.ks_p(a, a) == 1.0 and adaptive.ks_p(a, a + 100) < 1e-10


def rows():
    rng = random.Random(2)
    return [(k, t, None if rng.random() < 0.05 else rng.gauss(5.0 * (t >= 150) * (k > 0), 1)) for k in range(3) for t in range(300)]


@pytest.mark.parametrize("parts", [1, 5])
def test_series_do_not_mix_and_steps_are_found(spark, parts):
    df = spark.createDataFrame(rows(), "k long, t long, x double").repartition(parts)
    for out in (adaptive.adwin(df, ["k"], ["t"], "x", clock=4), adaptive.kswin(df, ["k"], ["t"], "x", alpha=1e-6)):
        got = out.orderBy("k", "t").collect()
        assert len(got) == 900
        for k in range(3):
            e = [r.evidence for r in got if r.k == k]
            assert e == sorted(e)
            found = [r.t for r in got if r.k == k and r.drift and r.t >= 150]
            assert bool(found and found[0] < 200) == (k > 0)
    by_hand = adaptive.AdwinEvidence(0.0, 1.0, clock=4)
    want = [by_hand.update(x)[0] for k, _, x in rows() if k == 1]
    assert [r.evidence for r in adaptive.adwin(df, ["k"], ["t"], "x", clock=4).where("k = 1").orderBy("t").collect()] == want


def test_odd_series(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 0, float("nan")), (2, 1, 3.0)], "k long, t long, x double")
    assert [r.evidence for r in adaptive.adwin(df, ["k"], ["t"], "x").collect()] == [0.0] * 3
    assert adaptive.kswin(df.limit(0), ["k"], ["t"], "x").count() == 0
    flat = adaptive.change_scores(df.withColumn("hit", F.lit(None).cast("boolean")), ["k"], "t", "t", "hit", "x", 5.0).collect()
    assert all(r.near == 0 and r.count01 == 0 for r in flat)
