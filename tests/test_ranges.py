"""Range joins by a running maximum and exact order statistics against plain versions, and one hot component."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from axlewatch.operators import detect, episodes, features, guards, joins, ranked
from axlewatch.operators.ranked import order_statistics


def data(seed, n=200, m=40):
    rng = random.Random(seed)
    rows = [(i, rng.choice([1, 2, None]), rng.choice([rng.randint(0, 500), None]) if rng.random() < 0.1 else rng.randint(0, 500)) for i in range(n)]
    spans = [(i, rng.choice([1, 2, None]), a, a + rng.randint(-3, 40) if rng.random() > 0.1 else None) for i in range(m) for a in [rng.randint(0, 500)]]
    return rows, spans


@pytest.mark.parametrize("seed", [1, 2])
def test_cover_and_overlap_equal_nested_loops(spark, seed):
    rows, spans = data(seed)
    r = spark.createDataFrame(rows, "event_id long, component_id long, t long")
    f = spark.createDataFrame(spans, "fault_id long, component_id long, onset long, failure long")
    ok = [(i, c, a, b) for i, c, a, b in spans if c is not None and b is not None]

    def inside(c, t, a, b):
        return c is not None and t is not None and a <= t <= b

    x = joins.reached(r, f, ["component_id"], F.col("t"), F.col("onset"), F.col("failure"))
    got = {e.event_id for e in x.where("_reach >= t").collect()}
    assert got == {i for i, c, t in rows if any(k == c and inside(c, t, a, b) for _, k, a, b in ok)}
    labels = {e.event_id: (e.is_faulty, e.fault_id) for e in joins.label_from_events(r, f, cell=30).collect()}
    for i, c, t in rows:
        hits = [j for j, k, a, b in ok if k == c and inside(c, t, a, b)]
        assert labels[i] == (bool(hits), max(hits, default=None))
    left = {e.event_id for e in joins.blank_post_failure(r, f, 25).collect()}
    assert left == {i for i, c, t in rows if not any(k == c and c is not None and t is not None and b < t <= b + 25 for _, k, a, b in ok)}
    kept = {e.event_id for e in guards.normal_window_guard(r, f, "component_id", "t", 50, 400, 9).collect()}
    assert kept == {i for i, c, t in rows if t is not None and 50 <= t < 400 and not any(k == c and abs(t - b) <= 9 for _, k, a, b in ok)}


def test_order_statistics_equal_numpy(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, 1.0, 2.0, rng.gauss(0, 5)])) for k in "abc" for _ in range(101)] + [("d", 4.0), ("e", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {r.k: (r.lo, r.mid, r.hi) for r in order_statistics(df, "x", {"lo": 0.1, "mid": 0.5, "hi": 0.995}, ["k"]).collect()}
    want = {k: tuple(np.quantile([x for j, x in rows if j == k and x is not None], [0.1, 0.5, 0.995])) for k in "abcd"}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12)
    assert order_statistics(df.where("k = 'e'"), "x", {"mid": 0.5}).collect()[0].mid is None


def test_means_and_peers_by_hand(spark):
    rng = random.Random(4)
    rows = [(k, i, None if rng.random() < 0.2 else rng.choice([float("nan"), rng.gauss(0, 1)]) if rng.random() < 0.1 else rng.gauss(0, 1)) for k in (1, 2) for i in range(700)]
    df = spark.createDataFrame(rows, "k long, i long, x double")
    got = {(r.k, r.i): r.ewma for r in features.ewma(df, ["k"], ["i"], "x", 0.2).collect()}
    for k in (1, 2):
        mean = None
        for j, i, x in rows:
            if j == k:
                if x is not None and x == x:
                    mean = x if mean is None else 0.8 * mean + 0.2 * x
                assert got[k, i] == (None if mean is None else pytest.approx(mean, rel=1e-9))
    peers = [(g, i, None if rng.random() < 0.2 else float(rng.randint(0, 4))) for g in range(12) for i in range(g % 6 + 1)]
    out = {(r.g, r.i): r.peer_delta for r in features.peer_delta(spark.createDataFrame(peers, "g long, i long, x double"), ["g"], "x", "median").collect()}
    for g, i, x in peers:
        rest = [y for h, j, y in peers if h == g and j != i and y is not None]
        if x is not None:
            assert out[g, i] == pytest.approx(x - np.median(rest) if rest else 0.0)


def test_one_hot_component_ends_in_time(spark):
    """400,000 rows and 10,000 episodes of one component: a join by component alone would make 4 * 10**9 pairs."""
    n = 400_000
    df = spark.range(n).select(F.lit(1).alias("component_id"), F.col("id").alias("t"), F.col("id").alias("event_id"), F.when(F.col("id") % 40 < 2, 200.0).otherwise(1.0).alias("score"))
    began = time.time()
    ep = episodes.episodes(df, ["component_id"], "t", "event_id", F.col("score") > 100, "score", 2, 5, 100)
    assert ep.agg(F.count(F.lit(1)), F.sum("n_rows")).first() == (n // 40, n // 20)
    faults = spark.range(5000).select(F.col("id").alias("fault_id"), F.lit(1).alias("component_id"), (F.col("id") * 80).alias("onset"), (F.col("id") * 80 + 10).alias("failure"))
    assert joins.blank_post_failure(df, faults, 5).count() == n - 25_000
    assert joins.label_from_events(df, faults, cell=80).where("is_faulty").count() == 55_000
    assert time.time() - began < 120


def test_a_median_equal_to_the_floor_is_not_below_it(spark):
    """The 0.4 quantile of 0.1 and 0.4 is 0.22, in doubles a little over it."""
    df = spark.createDataFrame([(1, i, t, v) for i, (t, v) in enumerate([(0, 0.1), (1, 0.4), (100, 0.22), (200, 0.21)])], "c int, id int, t long, v double")
    got = detect.duty_ratio(df, ["c"], ["t", "id"], "t", "v", 1, 2, 0, low=0.4)
    assert sorted(r.id for r in got.collect()) == [0, 3]


def test_a_quantile_ranks_few_values_and_is_exact(spark, monkeypatch):
    df = spark.range(50_000).select(F.when(F.col("id") % 7 != 0, (F.xxhash64("id") % 1_000_003) / 7).alias("v"), (F.col("id") % 3).alias("w")).checkpoint()
    ranked_rows = []
    sums = ranked.running_sums
    monkeypatch.setattr(ranked, "running_sums", lambda g, *a: (ranked_rows.append(g.count()), sums(g, *a))[1])
    for q in (0.0, 0.3333, 0.75, 1.0):
        monkeypatch.setattr(ranked, "ONE_TASK", 0)
        got = ranked.quantile(df, "v", q)
        assert ranked_rows[-1] < 200
        assert got == pytest.approx(ranked.order_statistics(df, "v", {"q": q}).first().q, rel=1e-15)
        monkeypatch.setattr(ranked, "ONE_TASK", 100_000)
        assert ranked.quantile(df, "v", q) == got
    assert ranked.quantile(df, "w", 0.5) == 1.0 and ranked.quantile(df.where("v is null"), "v", 0.5) is None
    monkeypatch.setattr(ranked, "SKETCH", 10)
    assert ranked.quantile(df, "v", 0.6) == ranked.order_statistics(df, "v", {"q": 0.6}).first().q


def test_case_ranks_are_dealt_by_rows(spark, monkeypatch):
    """More rows mean more tasks, and ties, NULLs and counts come out as from separate windows."""
    from axlewatch.operators import episodes, rankers, ranked

    monkeypatch.setattr(ranked, "TASK_ROWS", 100)
    df = spark.range(3000).select((F.col("id") % 500).alias("k"), F.when(F.col("id") % 11 > 0, F.col("id") * 7 % 4).alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    got = rankers.borda_score(df, ["k"], {"a": 1.0, "b": 0.5})
    assert got.rdd.getNumPartitions() >= 30
    groups = {}
    for r in df.collect():
        groups.setdefault(r.k, []).append(r)

    def share(rows, r, c):
        v = r[c]
        above = sum(x[c] is not None and x[c] > v for x in rows)
        return (len(rows) - (above + 1 + (sum(x[c] == v for x in rows) - 1) / 2)) / len(rows)

    want = sorted((r.k, r.b, round((share(g, r, "a") if r.a is not None else 0.0) + 0.5 * share(g, r, "b"), 9)) for g in groups.values() for r in g)
    assert sorted((r.k, r.b, round(r.score, 9)) for r in got.collect()) == want
    assert episodes.monotonicity(df, ["k"], "a", "b").rdd.getNumPartitions() >= 30
