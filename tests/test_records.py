"""Range-aware volumes against a brute-force sum, and drift, cycles, masks and folds by hand, with NULLs and ties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from axlewatch.operators import drift, features, intervals, peers, report, saloon, serve, splits, volume


def brute_vus(score, y, buffer, thresholds):
    n, pos = len(y), sum(y)
    seq = [(i, next(j for j in range(i, n) if j + 1 == n or not y[j + 1])) for i in range(n) if y[i] and (i == 0 or not y[i - 1])]
    t = min(max(thresholds, 2), n)
    cuts = [sorted(score, reverse=True)[k * (n - 1) // (t - 1)] for k in range(t)]
    areas = []
    for w in range(buffer + 1):
        h = w // 2
        soft = [0.0 if y[p] else min(1.0, sum(math.sqrt(1 - d / w) for s, e in seq for d in [s - p if p < s else p - e] if d <= h)) for p in range(n)]
        wide = []
        for s, e in seq:
            if wide and wide[-1][1] >= s - h:
                wide[-1][1] = e + h
            else:
                wide.append([s - h, e + h])
        before = area = 0.0
        for cut in cuts:
            hit = [x >= cut for x in score]
            x = sum(a for a, b in zip(soft, hit, strict=True) if b)
            true = sum(a and b for a, b in zip(y, hit, strict=True)) + x
            there = sum(any(hit[max(a, 0) : b + 1]) for a, b in wide) / len(wide)
            recall = min(true / ((pos + pos + x) / 2), 1) * there
            area, before = area + (recall - before) * true / sum(hit), recall
        areas.append(area)
    return sum(areas) / len(areas)


@pytest.mark.parametrize("buffer", [0, 1, 7])
def test_vus_pr_equals_brute_force(spark, buffer):
    r = random.Random(buffer)
    y = [r.random() < 0.3 for _ in range(60)]
    score = [round(r.random() + 0.3 * a, 1) for a in y]  # ties
    rows = [(i, s, a) for i, (s, a) in enumerate(zip(score, y, strict=True))] + [(100, None, True), (101, 0.5, None), (102, float("nan"), False)]
    got = volume.vus_pr(spark.createDataFrame(rows, "i long, s double, y boolean"), ["i"], "s", "y", buffer, 25).first()[0]
    assert got == pytest.approx(brute_vus(score, y, buffer, 25), abs=1e-9)


def test_vus_pr_of_one_class_is_null(spark):
    d = spark.createDataFrame([(i, 0.1 * i, False) for i in range(5)], "i long, s double, y boolean")
    assert [r[0] for r in volume.vus_pr(d, ["i"], "s", "y", 4).collect()] == [None]
    assert [r[0] for r in volume.vus_pr(d.where("i < 0"), ["i"], "s", "y", 4).collect()] == [None]


def test_page_hinkley_finds_a_step_and_never_falls(spark):
    rows = [("a", i, 0.0 if i < 50 else 10.0) for i in range(100)] + [("b", i, None) for i in range(3)]
    out = drift.page_hinkley(spark.createDataFrame(rows, "k string, t long, x double"), ["k"], ["t"], "x", threshold=20.0, warm=5).orderBy("k", "t").collect()
    a = [r for r in out if r.k == "a"]
    assert not any(r.drift for r in a[:50]) and any(r.drift for r in a[50:55])
    assert all(p.evidence <= q.evidence for p, q in zip(a, a[1:]))
    assert [r.evidence for r in out if r.k == "b"] == [0.0, 0.0, 0.0]


def test_nearest_cycle_prefers_whole_ones_and_the_least_reach(spark):
    rows = [("a", t) for t in (0, 1, 2, 40, 41, 60, 61, 62)] + [("b", 500)] + [("c", 5000)]
    out = serve.nearest_cycle(spark.createDataFrame(rows, "k string, t long"), ["k"], "t", 45, 5, (17, 1000)).collect()
    assert sorted(map(tuple, out)) == [("a", 40, 41, 2), ("b", 500, 500, 1)]


def test_masks_of_a_case_without_outdoor_readings(spark):
    rows = [(1, 1, t, v, None) for t, v in enumerate([20.0, 20.0, None, 30.0])]
    m = saloon.case_masks(spark.createDataFrame(rows, "g int, car int, t int, i double, o double"), "g", "car", "t", "i", "o", F.lit(True), F.lit(None).cast("boolean") | (F.col("t") < 9), 3).orderBy("t").collect()
    assert [r.usable for r in m] == [True, True, False, True]
    assert [r.hot for r in m] == [True, True, False, True]


def test_folds_keep_groups_whole_and_alike(spark):
    d = spark.createDataFrame([(g, i) for g, n in (("a", 5), ("b", 4), ("c", 3), ("d", 2), (None, 1)) for i in range(n)], "g string, i int")
    f = splits.group_kfold(d, "g", 2).groupBy("g").agg(F.collect_set("fold").alias("f"), F.count("i").alias("n")).collect()
    assert all(len(r.f) == 1 for r in f) and sum(r.n for r in f) == 15
    assert {r.g: r.f[0] for r in f if r.g} == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_slices_overlap_by_half(spark):
    d = spark.createDataFrame([("r", p, 8) for p in range(8)], "k string, p int, n int")
    s = splits.subwindow_slices(d, ["k"], "p", "n").groupBy("slice").agg(F.array_sort(F.collect_list("p")).alias("p")).orderBy("slice").collect()
    assert [r.p for r in s] == [[0, 1, 2, 3], [2, 3, 4, 5], [4, 5, 6, 7]]


def test_gap_is_null_safe_and_guards_name_what_is_wrong(spark):
    d = spark.createDataFrame([("m", None, "rnd", 0.9), ("m", None, "grp", 0.7), ("n", 1, "grp", 0.5)], "m string, w int, s string, f double")
    assert sorted((r.m, r.generalisation_gap) for r in report.generalisation_gap(d, ["m", "w"], "s", "f", "rnd", "grp").collect()) == [("m", pytest.approx(0.2)), ("n", None)]
    g = spark.createDataFrame([(1, 2, 0, 5.0), (1, 2, 9, 5.0), (2, 3, 0, 1.0)], "g int, n int, t int, x double")
    assert sorted(map(tuple, peers.peer_group_guards(g, ["g"], "n", "t", ["x"], 5).collect())) == [(1, "constant:x"), (1, "start"), (2, "size")]


def test_stress_of_short_and_null_records(spark):
    d = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 0.0), ("b", 1, None), ("b", 2, 4.0)], "k string, t int, x double")
    s = {r.k: r for r in features.stress_stats(d, ["k"], ["t"], "x", (0.5,)).collect()}
    assert (s["a"].p2p, s["a"].std, s["a"].roughness, s["a"]["up_0.5"]) == (0.0, 0.0, 0.0, 1)
    assert (s["b"].p2p, s["b"].roughness, s["b"]["up_0.5"]) == (4.0, 4.0, 1)


def test_peer_groups_end_at_a_repeated_series_and_at_the_tolerance(spark):
    rows = [("u", "a", 0, 1), ("u", "b", 2, 2), ("u", None, 3, 3), ("u", "a", 4, 4), ("u", "b", 20, 5), ("v", "a", 0, 6), ("v", "b", None, 7)]
    d = spark.createDataFrame(rows, "u string, s string, t long, i long")
    assert sorted((r.i, r.peer_group) for r in peers.peer_groups(d, "u", "s", "t", "i", 5).collect()) == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 3), (6, 1)]


def test_alert_context_lists_the_last_events_inside(spark):
    e = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 20, 30), (2, 0, 100, 110)], "component_id int, episode int, t_start long, t_end long")
    s = spark.createDataFrame([(1, t, t, float(t)) for t in (0, 5, 10, 15, 30)], "component_id int, t long, event_id long, score double")
    out = {(r.component_id, r.episode): (r.score, r.peak, r.events) for r in serve.alert_context(e, s, ["component_id"], "episode", 2).collect()}
    assert out == {(1, 0): (10.0, 10.0, [10, 5]), (1, 1): (30.0, 30.0, [30]), (2, 0): (None, None, [])}


def test_validation_guard_bars_unknown_parts(spark):
    d = spark.createDataFrame([(1, "val"), (2, "train"), (3, None)], "i long, part string")
    a, b = report.validation_guard(d, "part", "i").first(), report.validation_guard(d.where("i = 1"), "part", "i").first()
    assert (a.allowed, a.barred) == (1, 2) and a.digest == b.digest
    assert tuple(report.validation_guard(d.where("i > 9"), "part", "i").first()) == (0, 0, 0)


def test_selection_defers_where_no_metric_is(spark):
    d = spark.createDataFrame([("s", "a", False, 0.9), ("s", "b", True, 0.5), ("s", "c", None, 1.0), ("s", "control", True, 0.1), ("z", "a", True, None)], "s string, n string, m boolean, x double")
    assert sorted(map(tuple, report.select_per_subsystem(d, "s", "n", "m", ["x"], "control").collect())) == [("s", "b", 0.5, False, 0.1), ("z", "a", None, True, None)]


def test_matching_goes_by_falling_overlap(spark):
    r = random.Random(3)
    made = [[(k, i, a, a + r.randrange(1, 30)) for k in (1, 2) for i in range(12) for a in [r.randrange(100)]] for _ in range(2)]
    truth, found = (spark.createDataFrame(m, "k int, id int, a long, b long") for m in made)
    pairs, want = [], []
    for k, i, a, b in made[0]:
        for q, j, c, d in made[1]:
            inter = min(b, d) - max(a, c)
            if k == q and inter > 0:
                pairs.append((k, i, j, inter / (b - a + d - c - inter)))
    for k, i, j, x in sorted(pairs, key=lambda p: (-p[3], p[1], p[2])):
        if not any(k == q and (i == s or j == t) for q, s, t, _ in want):
            want.append((k, i, j, x))
    got = intervals.overlaps(truth, found, ["k"], 7)
    assert sorted(map(tuple, got.collect())) == sorted(pairs)
    assert sorted(map(tuple, intervals.iou_match(got, ["k"]).collect())) == sorted(want)
    none = intervals.iou_match(got.where("iou > 2"), ["k"])
    assert tuple(intervals.iou_f1(truth, found, none).first()) == (0.0, 0.0, 0.0)


def test_baseline_of_an_unknown_operation_is_that_of_all(spark):
    t = spark.createDataFrame([("a", 10.0), ("a", 10.0), ("b", 0.0), (None, 4.0)], "o string, x double")
    d = spark.createDataFrame([("a", 11.0), ("b", 2.0), ("c", 14.0), (None, None)], "o string, x double")
    out = {r.o: (r.rel, r.z) for r in features.fold_baseline(d, t, "o", "x").collect()}
    assert out["a"] == (1.1, 2.0) and out["b"] == (None, 2.0) and out[None] == (None, None)
    assert out["c"] == (2.0, pytest.approx(7 / (1.4826 * 3)))
