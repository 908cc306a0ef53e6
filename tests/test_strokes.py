"""Strokes, tacho windows, fingerprints, power laws and ranks against hand-counted cases."""

import math

from pyspark.sql import functions as F

from axlewatch.operators import rankers, strokes


def test_strokes_share_their_turning_row_and_drop_waits(spark):
    x = [0.0, 1.0, 2.0, 2.0, 2.01, 1.0, 0.0, None, 0.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)] + [("flat", i, 5.0) for i in range(4)], "k string, t int, v double")
    got = strokes.monotone_strokes(df, ["k"], "t", "v", "t").orderBy("stroke", "pos").collect()
    assert [(r.k, r.t, r.pos) for r in got] == [("a", 0, 0), ("a", 1, 1), ("a", 2, 2), ("a", 4, 0), ("a", 5, 1), ("a", 6, 2)]
    zigzag = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 1.0, 2.0, 1.0, 0.0])], "k string, t int, v double")
    got = strokes.monotone_strokes(zigzag, ["k"], "t", "v", "t").orderBy("stroke", "pos").collect()
    assert [r.t for r in got] == [0, 1, 2, 2, 3, 4]
    f = strokes.stroke_features(strokes.monotone_strokes(zigzag, ["k"], "t", "v", "t").withColumn("c", -F.col("t")), ["k"], "c", "v", "c", 2.0).orderBy("stroke").collect()
    assert [(r.n_samples, r.duration_s, r.i_peak, r.direction, r.pos_ref_range, r.v_ref) for r in f] == [(3, 1.5, 2, 1, 2.0, 2.0), (3, 1.5, 4, -1, 2.0, 2.0)]


def test_a_step_of_just_the_share_is_a_wait_whatever_its_last_bit(spark):
    """0.4 - 0.3 is a little over 0.05 * 2 in doubles only."""
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 2.0] * 40 + [0.3, 0.4])], "k string, t int, v double")
    assert {r.v for r in strokes.monotone_strokes(df, ["k"], "t", "v", "t", least=2).collect()} == {0.0, 2.0, 0.3}


def test_tacho_windows_count_inside_only_and_cut_the_tail(spark):
    df = spark.createDataFrame([("a", i, i % 2) for i in range(9)] + [("b", 0, 1), ("b", 1, 0), ("b", 2, None)], "k string, t int, v int")
    got = strokes.tacho_windows(df, ["k"], "t", F.col("v") == 1, "t", 4, 4.0, 1.0).orderBy("k", "window").collect()
    assert [(r.k, r.window, r.n_edges, round(r.speed_kmh, 6)) for r in got] == [("a", 0, 3, 5.4), ("a", 1, 3, 5.4), ("b", 0, 1, 2.4)]


def test_fingerprints_group_equal_beginnings(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, None), (1, 2, 9), (2, 0, 5), (2, 1, None), (2, 2, 8), (3, 0, 5)], "k int, t int, v int")
    two = strokes.recording_fingerprint(df, ["k"], ["t"], F.col("v"), 2)
    assert [(r["first"], r.n) for r in strokes.duplicate_groups(two, "k").collect()] == [(1, 2)]
    assert strokes.duplicate_groups(strokes.recording_fingerprint(df, ["k"], ["t"], F.col("v"), 3), "k").count() == 0


def test_power_law_finds_its_exponent_and_drops_what_has_none(spark):
    df = spark.createDataFrame([("a", float(x), 3.0 * x**1.5) for x in range(1, 6)] + [("a", -1.0, 2.0), ("b", 2.0, 1.0), ("b", 2.0, 3.0), ("b", 2.0, 4.0), ("c", 1.0, 1.0)], "k string, x double, y double")
    (r,) = strokes.power_law_fit(df, ["k"], "x", "y").collect()
    assert r.k == "a" and r.n == 5 and math.isclose(r.alpha, 1.5) and math.isclose(math.exp(r.intercept), 3.0) and r.stderr < 1e-6 and (r.x_lo, r.x_hi) == (1.0, 5.0)


def test_ranks_share_ties_and_put_unusable_rows_last(spark):
    df = spark.createDataFrame([("c", "x", 5.0, True), ("c", "y", 5.0, True), ("c", "z", 1.0, True), ("c", "w", None, True), ("c", "v", 9.0, False)], "k string, n string, a double, ok boolean")
    b = {r.n: r.score for r in rankers.borda_score(df, ["k"], {"a": 1.0}).collect()}
    assert b == {"v": 0.8, "x": 0.5, "y": 0.5, "z": 0.2, "w": None}
    z = {r.n: r.score for r in rankers.zsum_score(df, ["k"], {"a": 1.0}).collect()}
    assert z["x"] == 0 and z["w"] is None and math.isclose(z["v"], 4 / (1.4826 * 2))
    ranked = rankers.rank_case(rankers.zsum_score(df, ["k"], {"a": 1.0}), ["k"], "score", [], "n", F.col("ok")).orderBy("rank").collect()
    assert [r.n for r in ranked] == ["x", "y", "z", "v", "w"]
    (c,) = rankers.chance_floor_rank(df, ["k"], F.col("ok")).collect()
    assert math.isclose(c.uniform, 0.6) and math.isclose(c.blind, (10 - 4 + 1) / 10)
    assert rankers.borda_score(df.limit(0), ["k"], {"a": 1.0}).count() == 0
