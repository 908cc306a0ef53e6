"""Cycle features against plain loops."""

import numpy as np
import pytest

from axlewatch.operators import cycles


def test_compressor_by_hand(spark):
    current = [3.0, 0.0, 6.0, 6.0, 6.0, 6.0, 8.0, 3.0, 1.0, 1.0, 5.0]
    names = ["Motor_current", "Reservoirs", "Oil_temperature", "TP2", "TP3", "H1", "LPS", "Towers", "Pressure_switch"]
    rows = [(1, int(1e7 * i) + (90_000_000 if i > 8 else 0), i, c, 8.0 + i, 60.0 + i, 9.0, 8.0, float(i), 1.0 * (i == 4), float(i > 2), float(i % 2)) for i, c in enumerate(current)]
    df = spark.createDataFrame(rows, f"k long, t long, i long, {', '.join(f'{n} double' for n in names)}").repartition(3)
    got = cycles.compressor_cycle_features(df, ["k"], "t", "i").orderBy("cycle").collect()
    assert [r.cycle for r in got] == [0, 1, 2]
    a = got[1]
    assert (a.t_loaded, a.t_unloaded, a.t_off) == (50.0, 10.0, 70.0) and a.I_loaded_mean == 8.0 and a.I_start_peak == 8.0
    assert a.H1_loaded_mean == 4.0 and a.TP2_minus_TP3_mean == 1.0 and a.LPS_any and a.tower_switches == 1 and a.purge_count == 4
    assert a.dP_dt_loaded == pytest.approx(0.1) and a.dP_dt_off == pytest.approx((0.1 + 1 / 60) / 2) and a.duty_ratio == pytest.approx(50 / 130)
    assert got[0].I_loaded_mean is None and got[0].idle_run_ratio is None and got[2].t_loaded == 10.0


def test_door_speeds_and_phases(spark):
    rng = np.random.default_rng(7)
    t = np.cumsum(rng.choice([20_000, 30_000, 50_000], 40))
    p = np.linspace(5, 700, 40) + rng.normal(0, 2, 40)
    i = rng.uniform(200, 900, 40)
    rows = [(1, int(a), n, float(b), 24.0, 9.0, float(c), 30.0, 0.0) for n, (a, b, c) in enumerate(zip(t, i, p))] + [(2, 0, 0, 5.0, 1.0, 1.0, 3.0, 0.0, 0.0), (3, 0, 0, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "k long, t long, n long, current double, voltage double, emf double, position double, open_time double, close_time double").repartition(4)
    got = {r.k: r for r in cycles.door_cycle_features(df, ["k"], "t", "n").collect()}
    a = got[1]
    secs, f = (t - t[0]) / 1e6, np.clip((p - p[0]) / (p[-1] - p[0]), 0, 1)
    cruise = (f >= 0.15) & (f <= 0.85)
    speed = np.abs(np.gradient(f, secs))
    assert a.operation == "Open" and a.travel == pytest.approx(p[-1] - p[0]) and a.duration == pytest.approx(secs[-1])
    assert a.speed_cruise == pytest.approx(speed[cruise].mean()) and a.i_mean_cruise == pytest.approx(i[cruise].mean())
    assert a.charge == pytest.approx((i * np.diff(secs, prepend=0)).sum()) and a.i_peak_frac == pytest.approx(f[i.argmax()])
    assert a.r_proxy == pytest.approx((240 - 9) / i[cruise].mean()) and a.duration_vs_cmd == pytest.approx(secs[-1] / 3)
    assert got[2].i_mean_cruise == 5.0 and got[2].duration_vs_cmd is None and got[3].i_mean is None
