"""Hand-computed cases of the engine's operators."""

import random

import pytest
from pyspark.sql import functions as F

from axlewatch.operators import episodes, features, guards, joins, ranked, reshape, segments, serve, validate


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def series(spark, *pairs):
    return spark.createDataFrame([(1, i, t, v) for i, (t, v) in enumerate(pairs)], "c int, id int, t long, v double")


def test_gap_equal_to_the_limit_is_no_gap(spark):
    got = segments.gap_segments(series(spark, (0, 1.0), (10, 1.0), (21, 1.0)), ["c"], "t", 10, "id")
    assert rows(got, "id", "segment") == [(0, 0), (1, 0), (2, 1)]


def test_windows_drop_the_partial_tail(spark):
    got = segments.make_windows(series(spark, *[(i, 0.0) for i in range(8)]), ["c"], "t", 4, 2, "id")
    assert rows(got.groupBy("window").agg(F.min("id").alias("a"), F.count("*").alias("n")), "window", "a", "n") == [(0, 0, 4), (1, 2, 4), (2, 4, 4)]


def test_one_sample_has_no_statistics(spark):
    df = series(spark, (0, 1.0), (1, None)).withColumn("pos", F.col("id"))
    assert features.window_stats(df, ["c"], "v", "pos").first()["mean"] is None


def test_peers_leave_the_row_out(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 6.0)], "g int, v double")
    assert [round(x[1], 6) for x in rows(features.peer_normalise(df, ["g"], "v"), "v", "peer_delta")] == [-3.0, -1.5, 4.5]


def test_episodes_need_k_rows_and_strictly_more(spark):
    over = lambda *v: episodes.episodes(series(spark, *[(i * 10, x) for i, x in enumerate(v)]), ["c"], "t", "id", F.col("v") > 1, "v", 2, 25, 15)
    assert over(1.0, 1.0, 1.0).count() == 0
    assert rows(over(2.0, 2.0, 0.0, 3.0, 2.0), "t_start", "t_end", "n_rows", "peak") == [(0, 40, 5, 3.0)]
    assert rows(over(2.0, 2.0, 0.0, 0.0, 3.0, 2.0), "t_start", "t_end") == [(0, 10), (40, 50)]


def test_episode_is_cut_at_a_long_step(spark):
    df = series(spark, (0, 2.0), (10, 2.0), (100, 2.0), (110, 2.0))
    got = episodes.episodes(df, ["c"], "t", "id", F.col("v") > 1, "v", 2, 50, 20)
    assert rows(got, "t_start", "t_end") == [(0, 10), (100, 110)]


def test_unknown_failure_has_no_rul_and_no_alarm(spark):
    r = spark.createDataFrame([(1, 5)], "component_id long, t long")
    f = spark.createDataFrame([(1, 0, None)], "component_id long, onset long, failure long")
    got = joins.label_from_fault_log(r, f).first()
    assert (got.is_faulty, got.severity, got.rul_s, got.alarm) == (True, 1.0, None, False)


def test_first_fault_in_log_order_claims_an_episode(spark):
    e = spark.createDataFrame([(1, 0, 10, 20)], "component_id long, episode long, t_start long, t_end long")
    f = spark.createDataFrame([(1, 1, 15, 30), (1, 2, 12, 25)], "component_id long, fault_id long, onset long, failure long")
    assert joins.match_episodes(e, f, 0).first().fault_id == 1


def test_auroc_is_null_with_one_class(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "s double, y int")
    assert episodes.auroc(df, "s", "y").first().auroc is None


def test_empty_tables_give_empty_results(spark):
    df = series(spark, (0, 1.0)).limit(0)
    assert segments.gap_segments(df, ["c"], "t", 10, "id").count() == 0
    assert episodes.episodes(df, ["c"], "t", "id", F.col("v") > 1, "v", 2, 25, 15).count() == 0


def test_missing_column_is_an_error(spark):
    try:
        validate.coerce_table(series(spark, (0, 1.0)), {"absent": "int"})
    except ValueError as e:
        assert "absent" in str(e)
    else:
        raise AssertionError


def test_null_readings_dont_stop_an_ewma(spark):
    df = series(spark, (0, None), (1, 10.0), (2, None), (3, float("nan")), (4, 20.0))
    assert rows(features.ewma(df, ["c"], ["t"], "v", 0.5).na.fill(-1.0), "t", "ewma") == [(0, -1.0), (1, 10.0), (2, 10.0), (3, 10.0), (4, 15.0)]
    two = df.unionByName(df.withColumn("c", F.lit(2)))
    assert features.ewma(two, ["c"], ["t"], "v", 0.5).where("t = 4").select("ewma").distinct().count() == 1


def test_null_activity_is_off(spark):
    df = series(spark, (0, 0.0), (1, None), (2, 60.0), (3, 0.0), (4, 60.0))
    assert rows(segments.duty_cycles(df, ["c"], "t", F.col("v") > 50, "id"), "t", "cycle") == [(2, 1), (3, 1), (4, 2)]


def test_block_edges_are_rounded(spark):
    got = rows(segments.contiguous_blocks(series(spark, *[(i, 0.0) for i in range(7)]), ["c"], "t", 5, "id"), "t", "block")
    assert [b for _, b in got] == [0, 1, 1, 2, 3, 3, 4]  # edges 1, 3, 4, 6


def test_least_and_greatest_skip_nulls(spark):
    df = series(spark, *enumerate([5.0, None, 1.0, 9.0, None, None, float("nan"), None]))
    assert rows(serve.series_minmax(df, ["c"], "t", "v", 4).na.fill(-1.0), "t", "value") == [(2, 1.0), (3, 9.0), (4, -1.0)]
    assert serve.series_minmax(df, ["c"], "t", "v", 8).count() == 8


def test_repeated_keys_are_an_error(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "b", 3.0)], "k int, s string, v double")
    with pytest.raises(ValueError, match="repeat"):
        reshape.to_wide(df, ["k"], "s", "v", ["a"])
    assert reshape.to_wide(df, ["k"], "s", "v", ["b"]).first().b == 3.0


def test_bins_tell_crossings(spark):
    got = segments.fixed_bins(series(spark, (0, 1.0), (1, 3.0), (10, 3.0), (11, None)), ["c"], "t", "v", 10, F.col("v") > 2)
    assert rows(got, "bin", "is_transition", "duty", "n") == [(0, True, 0.5, 2), (1, False, 1.0, 1)]


def test_alerts_are_flagged_by_position(spark):
    df = series(spark, (0, 2.0), (10, 2.0), (10, 0.0), (20, 0.0))
    got = episodes.alert_flags(df, ["c"], "t", "id", F.col("v") > 1, "v", 2, 25, 15)
    assert rows(got, "id", "alert") == [(0, True), (1, True), (2, False), (3, False)]


def test_budget_grid_equals_one_threshold_at_a_time(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(c, i, i * 10, r.choice([r.random(), r.random() ** 3])) for c in range(3) for i in range(120)], "c int, id int, t long, v double")
    got = episodes.calibrate_budget(df, ["c"], "t", "id", "v", 2, 25, 15, 1.0, 16).collect()
    for x in got[::5]:
        assert x.n_episodes == episodes.episodes(df, ["c"], "t", "id", F.col("v") > x.threshold, "v", 2, 25, 15).count()


def test_running_sums_over_any_ranges(spark):
    r = random.Random(2)
    data = [(g, r.randrange(50), 1) for g in "ab" for _ in range(300)]
    df = spark.createDataFrame(data, "g string, x int, n int").groupBy("g", "x").agg(F.sum("n").alias("n"))
    got = ranked.running_sums(df, ["x"], {"upto": F.col("n")}, ["g"]).collect()
    assert {(y.g, y.x): y.upto for y in got} == {(g, x): sum(a == g and b <= x for a, b, _ in data) for g, x, _ in data}
    assert ranked.running_sums(df.limit(0), ["x"], {"upto": F.col("n")}).count() == 0


def test_peers_by_median_leave_one_of_equals_out(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 5.0), (2, 7.0)], "g int, v double")
    assert rows(features.peer_delta(df, ["g"], "v", "median"), "g", "v", "peer_delta") == [(1, 1.0, -2.0), (1, 1.0, -2.0), (1, 5.0, 4.0), (2, 7.0, 0.0)]


def test_segments_take_the_label_they_share_most_with(spark):
    s = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 100, 101)], "component_id long, segment long, t_start long, t_end long")
    f = spark.createDataFrame([(1, 5, 8, 30), (1, 4, 0, 9), (1, 3, 0, 9), (1, 6, 90, 1000)], "component_id long, fault_id long, onset long, failure long")
    assert rows(guards.label_segments(s, f, "component_id", ["component_id", "segment"], "fault_id"), "segment", "label") == [(0, 3), (1, None)]


def test_partitions_dont_change_rows(spark):
    from axlewatch.plans.queries import QUERIES

    one = QUERIES["episodes_k1"](spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        other = QUERIES["episodes_k1"](spark, "/root/testdata/sf0.001").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(one.collect()) == sorted(other)


def test_stream_equals_batch(spark):
    from axlewatch.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    assert rows(QUERIES["stream_ewma_cusum"](spark, sf), "event_id", "cusum") == rows(QUERIES["cusum_two_sided"](spark, sf), "event_id", "cusum")


def test_ecod_keeps_windows_whose_ids_collide(spark, monkeypatch):
    from axlewatch.plans import alarms

    rows = spark.createDataFrame([(1, 0, 1000, 1.0, 1.0, 1.0), (1, 1, 0, 2.0, 2.0, 2.0), (2, 0, 0, 3.0, 3.0, 9.0)], "component_id long, segment long, window long, mean double, std double, peak double")
    monkeypatch.setattr(alarms, "window_features", lambda spark, sf_dir: rows)
    got = [tuple(r)[:3] for r in alarms.det_ecod(spark, "").collect()]
    assert sorted(got) == [(1, 0, 1000), (1, 1, 0), (2, 0, 0)]
