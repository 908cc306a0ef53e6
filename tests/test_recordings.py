"""Recorded files: names, headers, gaps, synonyms and errors; ridge against a direct solve."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from axlewatch.operators import ridge
from axlewatch.sources import recordings


def put(folder, name, text):
    (folder / name).write_text(text)
    return f"file://{folder}"


def test_compressor(spark, tmp_path):
    at = put(tmp_path, "c.csv", ",timestamp,TP2,H1\n0,2020-02-01 00:00:00,1.5,\n1,2020-02-01 00:00:10,x,2\n")
    got = sorted((r.t, r.signal, r.value) for r in recordings.compressor(spark, at, ["TP2", "H1"]).collect())
    assert got == [(1580515200000000, "H1", None), (1580515200000000, "TP2", 1.5), (1580515210000000, "H1", 2.0), (1580515210000000, "TP2", None)]
    with pytest.raises(ValueError, match="DV_pressure"):
        recordings.compressor(spark, at, ["DV_pressure"])


def test_bearing_takes_kind_and_state_from_the_name(spark, tmp_path):
    put(tmp_path, "H_1_0.csv", "Accelerometer,Speed\n1.0,10\n2.0,20\n")
    at = put(tmp_path, "O_16_2.csv", "Accelerometer,Speed\n0.5,30\n")
    got = sorted((r.kind, r.bearing, r.state, r.place, r.Accelerometer, r.Speed) for r in recordings.bearing(spark, at, {"Accelerometer": recordings.GRAVITY, "Speed": 1.0}).collect())
    assert got == [("H", 1, "0", 0, recordings.GRAVITY, 10.0), ("H", 1, "0", 1, 2 * recordings.GRAVITY, 20.0), ("O", 16, "2", 0, recordings.GRAVITY / 2, 30.0)]
    put(tmp_path, "X_1.csv", "Accelerometer,Speed\n1,1\n")
    with pytest.raises(PySparkException, match="unknown file name X_1.csv"):
        recordings.bearing(spark, at, {"Speed": 1.0}).collect()


def test_door(spark, tmp_path):
    at = put(tmp_path, "d.csv", "Datetime,Motor current(mA),Door leaf position\n2024-3-5-7-8-9-40,5,2\n2024-3-5-7-8-9-4,4,1\n")
    names = {"datetime": ["Datetime"], "current": ["Motor Current (mA)"], "position": ["Door leaf position"], "force": ["Motor force"]}
    got = recordings.door(spark, at, names, ["position"]).orderBy("place").collect()
    assert [(r.place, r.current, r.position, r.force) for r in got] == [(0, 4.0, 1.0, None), (1, 5.0, 2.0, None)] and got[1].t - got[0].t == 36_000
    with pytest.raises(ValueError, match="force"):
        recordings.door(spark, at, names, ["force"])
    put(tmp_path, "d.csv", "Datetime,Door leaf position\nsoon,1\n")
    with pytest.raises(PySparkException, match="no time of a row in d.csv"):
        recordings.door(spark, at, names, ["position"]).collect()


def test_rail(spark, tmp_path):
    at = put(tmp_path, "r.csv", "p,v1,s1,v2,s2\n1,0.5,nan,inf,2\n0,1,1,1,1\n")
    got = sorted(tuple(r)[1:] for r in recordings.rail(spark, at, boxes=2).collect())
    assert got == [(0, 1.0, 1, 0.5, 0.0), (0, 1.0, 2, 0.0, 2.0), (1, 0.0, 1, 1.0, 1.0), (1, 0.0, 2, 1.0, 1.0)]
    with pytest.raises(ValueError, match="129 columns are due"):
        recordings.rail(spark, at)


def test_stress_fills_gaps_and_refuses_bad_files(spark, tmp_path):
    at = put(tmp_path, "s.csv", "NA\r\n1\r\nnan\r\n\r\n4\r\n8\r\nNA\r\n")
    got = [r.value for r in recordings.stress(spark, at, 0.9).orderBy("place").collect()]
    assert got == [1.0, 1.0, 2.0, 3.0, 4.0, 8.0, 8.0]
    with pytest.raises(ValueError, match="4 of 7 lines of s.csv"):
        recordings.stress(spark, at)


def test_stress_reads_many_recordings_from_one_file(spark, tmp_path):
    at = put(tmp_path, "s.txt", "b,NA\nb,1\nb,\nb,3\na,1,5\na,1,x\na,1,7\n")
    got = [(r.file, r.place, r.value) for r in recordings.stress(spark, at, 0.9, named=True).orderBy("file", "place").collect()]
    assert got == [("a,1", 0, 5.0), ("a,1", 1, 6.0), ("a,1", 2, 7.0), ("b", 0, 1.0), ("b", 1, 1.0), ("b", 2, 2.0), ("b", 3, 3.0)]
    with pytest.raises(ValueError, match="1 of 3 lines of a,1"):
        recordings.stress(spark, at, named=True)


def test_panel_takes_the_first_name_with_data_for_each_car(spark, tmp_path):
    names = {"indoor": ["Indoor Average Temperature", "Cabin (new)"], "mode": ["Mode"]}
    at = put(tmp_path, "p.csv", "Time,Car 1 - Indoor Average Temperature,Car 1 - Cabin (new),Car 02 - indoor average temperature,Car 02 - Cabin (new),Car 02 - Mode,Car 02 - Other\n2024-01-01 00:00:00,20,99,NA,30,Stop,1\n2024-01-01 00:01:00,--,98,n/a,31,,1\nlater,1,1,1,1,x,1\n")
    got = sorted((r.car, r.field, r.t, r.value, r.word) for r in recordings.panel(spark, at, names, ["mode"]).collect())
    t = 1704067200000000
    assert got == [("02", "indoor", t, 30.0, None), ("02", "indoor", t + 60_000_000, 31.0, None), ("02", "mode", t, None, "Stop"), ("02", "mode", t + 60_000_000, None, None), ("1", "indoor", t, 20.0, None), ("1", "indoor", t + 60_000_000, None, None)]
    assert recordings.panel_header(["a"], names) == ["there is no Time column", "there is no column 'Car <n> - <parameter>'"]
    assert recordings.panel_header(["Time", "Car 1 - Mode"], names, cars=8) == ["there are 1 cars, not 8"]
    with pytest.raises(ValueError, match="no Time"):
        recordings.panel(spark, put(tmp_path, "p.csv", "x\n1\n"), names)


def test_ridge_equals_a_direct_solve(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3, 60, 2)) * [3, 10] + [1000, 5]
    y = x @ np.array([0.5, -2.0]) + 7 + rng.normal(size=(3, 60))
    rows = [(1, c, i, float(x[c, i, 0]), float(x[c, i, 1]), float(y[c, i]) + 3.0 * (c == 2)) for c in range(3) for i in range(60)] + [(1, 0, 99, None, 1.0, 1e9), (1, 3, 0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, car long, i long, a double, b double, y double").repartition(4)
    got = {r.car: r.coefficients for r in ridge.fit(df, ["k", "car"], ["a", "b"], "y").collect()}
    assert set(got) == {0, 1, 2}
    for c in range(3):
        d, t = x[c] - x[c].mean(0), y[c] + 3.0 * (c == 2)
        w = np.linalg.solve(d.T @ d + np.eye(2), d.T @ (t - t.mean()))
        assert np.allclose(got[c], [*w, t.mean() - w @ x[c].mean(0)], rtol=1e-9)
    r = {q.car: q.residual for q in ridge.peer_residual(df, "k", "car", ["i"], ["a", "b"], "y", F.lit(True), F.lit(True)).collect()}
    pred = np.median([x[2] @ got[c][:2] + got[c][2] for c in (0, 1)], axis=0)
    assert r[2] == pytest.approx(float(np.mean(y[2] + 3 - pred)), rel=1e-9) and r[2] > 2.5 and r[3] is None


def test_peer_residual_shuffles_no_predictions(spark):
    """Each row meets every peer's model, but what is shuffled grows with rows and models, not with their product; pieces and blocks don't change the result."""
    cars, days = 40, 30
    df = spark.range(cars * days).selectExpr("1L as k", f"id div {days} as car", f"id % {days} as i", "double(id * 7 % 31) as a", "double(id * id % 43) + id div 300 as y").checkpoint()
    args = (df, "k", "car", ["i"], ["a"], "y", F.lit(True), F.col("i") % 3 == 0)
    rows = [r for r in df.collect()]
    w = {r.car: r.coefficients for r in ridge.fit(df, ["k", "car"], ["a"], "y").collect()}
    over: dict[int, list] = {}
    for r in rows:
        if r.i % 3 == 0:
            over.setdefault(r.car, []).append(r.y - np.median([m[0] * r.a + m[1] for c, m in w.items() if c != r.car]))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ridge, "PIECE_ROWS", 50)
        m.setattr(ridge, "BLOCK", 90)
        r = ridge.peer_residual(*args, least=10)
        plan = r._jdf.queryExecution().optimizedPlan().toString()
        got = {x.car: x.residual for x in r.collect()}
    assert "percentile" not in plan
    assert got == {c: pytest.approx(float(np.mean(v)), rel=1e-9) for c, v in over.items()}
