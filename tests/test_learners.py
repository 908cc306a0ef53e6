"""Change-point scores, rules, folds and fitted models against slow versions and planted classes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from axlewatch.operators import changes, learners, segments


def slow_f1(truth, guess, margin):
    if not truth:
        return None
    left, hits = set(guess), 0
    for t in sorted(set(truth)):
        near = sorted((abs(t - x), x) for x in left if abs(t - x) <= margin)
        if near:
            hits += 1
            left.discard(near[0][1])
    p, r = hits / len(set(guess)) if guess else 0.0, hits / len(set(truth))
    return 2 * p * r / (p + r) if p + r else 0.0


def slow_covering(truth, guess, n):
    def parts(points):
        edges = sorted({0, n} | {p for p in points if 0 < p < n})
        return [set(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]

    return sum(len(a) * max(len(a & b) / len(a | b) for b in parts(guess)) for a in parts(truth)) / n


def test_change_point_scores_equal_slow_versions(spark):
    r = random.Random(3)
    series = {k: (r.randint(1, 60), [r.randint(-3, 62) for _ in range(r.randint(0, 9))], [r.randint(-3, 62) for _ in range(r.randint(0, 12))]) for k in range(60)}
    sizes = spark.createDataFrame([(k, n) for k, (n, _, _) in series.items()] + [(99, 0)], "k long, n long")
    truth, guess = (spark.createDataFrame([(k, p) for k, s in series.items() for p in s[i]], "k long, at long").repartition(3) for i in (1, 2))
    got = {x.k: x for x in changes.cpd_metrics(sizes, truth, guess, ["k"], "n", "at").collect()}
    assert got[99].covering is None and got[99].f1 is None and got[99].n_true == 0
    for k, (n, t, g) in series.items():
        assert got[k].covering == pytest.approx(slow_covering(t, g, n), abs=1e-12)
        want = [slow_f1(t, g, m) for m in range(1, 11)]
        assert (got[k].f1 is None) == (not t) and (not t or got[k].f1 == pytest.approx(want[4])) and (not t or got[k].mean_f1 == pytest.approx(sum(want) / 10))
        assert (got[k].n_true, got[k].n_guess) == (len(set(t)), len(set(g)))
    assert changes.cpd_metrics(sizes.limit(0), truth.limit(0), guess.limit(0), ["k"], "n", "at").count() == 0


def slow_rules(x, depth, tail):
    def build(rows, d):
        if d == 0 or len(rows) < 4:
            return len(rows)
        m, s = rows.mean(axis=0), rows.std(axis=0) + 1e-9
        f = int(np.argmax(np.abs((rows - m) / s).max(axis=0)))
        up = rows[:, f].max() - m[f] >= m[f] - rows[:, f].min()
        thr = np.quantile(rows[:, f], 1 - tail if up else tail)
        beyond = rows[:, f] > thr if up else rows[:, f] < thr
        if not beyond.any() or beyond.all():
            return len(rows)
        return f, up, thr, build(rows[beyond], d - 1), build(rows[~beyond], d - 1)

    tree = build(x, depth)

    def leaf(node, row):
        while isinstance(node, tuple):
            node = node[3] if (row[node[0]] > node[2] if node[1] else row[node[0]] < node[2]) else node[4]
        return node

    return [-math.log((leaf(tree, r) + 1) / (len(x) + 1)) for r in x]


@pytest.mark.parametrize(("rows", "depth"), [(300, 2), (300, 3), (10, 2), (3, 2)])
def test_rules_equal_a_recursive_tree(spark, rows, depth):
    rng = np.random.default_rng(rows)
    x = rng.normal(0, 1, (rows, 3))
    x[: rows // 20, 1] -= 9
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i long, a double, b double, c double").repartition(3)
    tree = learners.rule_tree(df, ["a", "b", "c"], depth)
    got = {r.i: r.s for r in df.select("i", learners.rule_score(tree).alias("s")).collect()}
    assert [got[i] for i in range(rows)] == pytest.approx(slow_rules(x, depth, 0.05))
    assert sum(n for _, n in learners.rule_texts(tree)) == rows


def test_a_flat_table_is_one_leaf(spark):
    tree = learners.rule_tree(spark.createDataFrame([(1.0, None)] * 9, "a double, b double"), ["a", "b"])
    assert tree == {1: {"n": 9}} and learners.rule_texts(tree) == [("all", 9)]


def planted(spark, n=600, classes=3):
    rng = np.random.default_rng(5)
    y = rng.integers(0, classes, n)
    y[: n // 2] = 0  # one class holds over half of the rows
    rows = [(i, "abc"[k], float(k * 3 + rng.normal()), float(rng.normal()), None if i % 50 == 0 else float(-k + rng.normal(0, 0.5))) for i, k in enumerate(y)]
    return spark.createDataFrame(rows, "id long, y string, speed_open double, noise double, current_cruise double").repartition(4)


F3 = ["speed_open", "noise", "current_cruise"]


@pytest.mark.parametrize("kind", ["logistic", "forest", "boosted", "regimes", "two", "stacked"])
def test_classifiers_tell_held_out_rows(spark, kind):
    df = planted(spark, classes=2 if kind in ("two", "stacked") else 3)
    train, held = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    small = {"rounds": 5, "depth": 3}
    if kind == "stacked":
        out = learners.stacked_probabilities(held, *learners.stacked(train, F3, "y", F.col("id") % 3))
    else:
        fits = {"logistic": lambda: learners.logistic(train, F3, "y"), "forest": lambda: learners.forest(train, F3, "y", trees=10), "boosted": lambda: learners.boosted(train, [F3], "y", seeds=(0, 1), **small), "regimes": lambda: learners.three_regime(train, F3, "y", **small), "two": lambda: learners.boosted(train, [F3], "y", **small)}
        out = fits[kind]().predicted(held)
    rows = out.collect()
    assert out.columns == [*df.columns, "probability", "predicted"] and len(rows) == held.count()
    assert all(sum(r.probability) == pytest.approx(1.0) for r in rows)
    assert sum(r.y == r.predicted for r in rows) > 0.85 * len(rows)


@pytest.mark.parametrize("kind", ["forest", "boosted", "stacked"])
def test_trees_are_told_cells_not_rows(spark, monkeypatch, kind):
    """Models see no more rows than there are bins and parts, and every row counts with its weight."""
    monkeypatch.setattr(learners, "PIECES", 50)
    seen, fit = [], learners.Pipeline.fit

    def spy(self, rows):
        seen.append((rows.count(), rows.agg(F.sum("_n")).first()[0] if "_n" in rows.columns else None))
        return fit(self, rows)

    monkeypatch.setattr(learners.Pipeline, "fit", spy)
    df = spark.range(20_000).select("id", (F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("b"), F.when(F.col("id") % 7 + F.col("id") % 5 > 5, "y").otherwise("x").alias("y"))
    if kind == "stacked":
        out = learners.stacked_probabilities(df, *learners.stacked(df, ["a", "b"], "y", F.col("id") % 3))
    else:
        out = (learners.forest(df, ["a", "b"], "y", trees=10) if kind == "forest" else learners.boosted(df, [["a", "b"]], "y", rounds=5)).predicted(df)
    assert out.columns == [*df.columns, "probability", "predicted"] and out.count() == 20_000
    assert out.where("y = predicted").count() > 19_000
    assert max(n for n, _ in seen) <= 3 * (35 + 50) and all(round(w) in (20_000, 13_333, 13_334, 6_666) for _, w in seen if w)


def test_bins_keep_rare_values_and_split_many_evenly(spark):
    df = spark.range(1000).select(F.when(F.col("id") == 5, 0.0).otherwise(1.0).alias("rare"), (F.col("id") * 2).alias("many"), F.when(F.col("id") == 3, float("nan")).alias("none"))
    bins = learners.bins_of(df, ["rare", "many", "none"])
    assert bins.starts["rare"] == [1.0] and bins.starts["none"] == [] and len(bins.starts["many"]) == learners.BINS - 1
    sizes = [r["count"] for r in bins.of(df).groupBy("_bin1").count().collect()]
    assert len(sizes) == learners.BINS and max(sizes) < 40 and {r[0] for r in bins.of(df).select("_bin2").distinct().collect()} == {0.0}


def test_groups_of_features_by_phase():
    assert learners.regime_groups(["i_open", "v_cruise", "closing_time", "temp"]) == [["i_open", "temp"], ["v_cruise", "temp"], ["closing_time", "temp"]]
    assert learners.regime_groups(["a", "b", "c", "d"]) == [["a"], ["b", "c"], ["d"]] and learners.regime_groups(["a"]) == [["a"]]


def test_one_class_is_refused(spark):
    with pytest.raises(ValueError, match="fewer than two"):
        learners.forest(planted(spark).where("y = 'a'"), F3, "y")


def test_clusters_and_large_ones(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 0.3, (200, 2)), rng.normal(20, 0.3, (180, 2)), rng.normal((60, -60), 0.3, (4, 2))])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i long, a double, b double")
    centres, sizes = learners.clusters(df, ["a", "b"], 3, seed=1)
    assert sorted(sizes) == [4, 180, 200]
    large = [centres[i] for i in learners.large_clusters(sizes)]
    far = {r.i: (r.k, r.c) for r in df.select("i", learners.nearest_centre(["a", "b"], centres).alias("k"), learners.nearest_centre(["a", "b"], large).alias("c")).collect()}
    assert all(far[i][0] < 3 for i in far) and all((far[i][1] > 50) == (i >= 380) for i in far)
    assert learners.large_clusters([50, 50]) == [0, 1] and learners.large_clusters([100, 3]) == [0] and learners.large_clusters([7]) == [0]


def test_forecasts_flag_the_window_that_breaks_the_rule(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in np.arange(5) * 0.5 + s], [float(s)] * 5) for i, s in enumerate(rng.normal(0, 3, 300))]
    rows[7] = (7, [*rows[7][1][:-1], rows[7][1][-1] + 40], rows[7][2])
    df = spark.createDataFrame(rows, "id long, u array<double>, v array<double>")
    models = learners.forecasts(df.where("id <> 7"), ["u", "v"], 5, rounds=10)
    out = {r.id: r for r in learners.forecast_residuals(df, models, 5).collect()}
    assert max(out, key=lambda i: out[i].score) == 7 and out[7].channel == "u" and out[7].z_u > 3 and len(out) == 300


def test_fold_scores_equal_a_fit_for_each_fold(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "pqrs"[i % 4], float(1e6 + rng.normal(i % 4, 1)), None if i % 9 == 0 else float(rng.normal())) for i in range(240)]
    df = spark.createDataFrame(rows, "i long, g string, a double, b double").repartition(3)
    got = {r.i: r for r in learners.leave_one_out_scores(df, "g", ["i"], ["a", "b"], F.col("i") % 5 == 0, 0.9).collect()}
    assert len(got) == len(rows)
    for g in "pqrs":
        fit = [(np.mean(v), np.std(v)) for c in (2, 3) for v in [[r[c] for r in rows if r[1] != g and r[0] % 5 and r[c] is not None]]]
        score = {r[0]: max(abs(r[c + 2] - m) / s for c, (m, s) in enumerate(fit) if r[c + 2] is not None) for r in rows}
        cut = np.quantile([score[r[0]] for r in rows if r[1] != g and r[0] % 5 == 0], 0.9)
        for r in rows:
            if r[1] == g:
                assert got[r[0]].score == pytest.approx(score[r[0]], rel=1e-6) and got[r[0]].threshold == pytest.approx(cut, rel=1e-6)


def test_windows_of_runs_carry_labels(spark):
    rows = [("r", 1, i * 1_000_000, float(i), i) for i in range(6)] + [("r", 1, 60_000_000 + i * 1_000_000, float(i), 10 + i) for i in range(4)]
    df = spark.createDataFrame(rows, "run string, c long, t long, v double, e long")
    faults = spark.createDataFrame([(1, 4_000_000, 61_000_000)], "c long, onset long, failure long")
    got = sorted((r.segment, r.window, r.samples, r.is_faulty, r.post_failure) for r in segments.telemetry_windows(df, faults, ["run", "c"], "c", "t", "v", "e", 1.0, 4, 2).collect())
    assert got == [(0, 0, [0.0, 1.0, 2.0, 3.0], False, False), (0, 1, [2.0, 3.0, 4.0, 5.0], True, False), (1, 0, [0.0, 1.0, 2.0, 3.0], True, True)]
