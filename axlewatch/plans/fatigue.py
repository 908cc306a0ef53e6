"""Queries of spectra and fatigue over the given tables: a component's readings in order of time are its recording."""

from __future__ import annotations

from pyspark.sql import functions as F

from axlewatch.operators import fatigue, segments
from axlewatch.plans.registry import query, r6
from axlewatch.sources.bind import TEL, telemetry

L, HOP = 16, 8
FRAMES = f"""{TEL}, placed as (select *, row_number() over (partition by component_id order by t, event_id) - 1 as p, count(*) over (partition by component_id) as n from tel),
fr as (select component_id, w, p - w * {HOP} as pos, value - avg(value) over (partition by component_id, w) as v from placed, unnest(generate_series(0, (n - {L}) // {HOP})) u(w) where n >= {L} and p between w * {HOP} and w * {HOP} + {L - 1}),
hn as (select i, 0.5 - 0.5 * cos(2 * pi() * i / {L}) as h from generate_series(0, {L - 1}) g(i)), ks as (select k from generate_series(0, {L // 2}) g(k)),
ft as (select component_id, w, k, pow(sum(v * h * cos(2 * pi() * k * pos / {L})), 2) + pow(sum(v * h * sin(2 * pi() * k * pos / {L})), 2) as power from fr join hn on hn.i = fr.pos, ks group by 1, 2, 3),
psd as (select component_id, k, k / {L}.0 as hz, avg(power * case when k in (0, {L // 2}) then 1 else 2 end / (select sum(h * h) from hn)) as psd from ft group by 1, 2)"""
TURN = f"""{TEL}, s1 as (select *, lag(value) over (partition by component_id order by t, event_id) as p from tel where value is not null),
s2 as (select *, lead(value) over (partition by component_id order by t, event_id) as n from s1 where p is null or p <> value),
tp as (select component_id, event_id, value from s2 where p is null or n is null or sign(value - p) <> sign(n - value))"""


def psd(spark, sf_dir):
    frames = segments.make_windows(telemetry(spark, sf_dir), ["component_id"], "t", L, HOP, "event_id")
    return fatigue.welch_psd(frames, ["component_id"], ["window"], "pos", "value", L)


def cycles(spark, sf_dir):
    points = fatigue.turning_points(telemetry(spark, sf_dir), ["component_id"], ["t", "event_id"], "value")
    return fatigue.rainflow_cycles(points, "component_id", ["t", "event_id"], "value")


@query(f"with {FRAMES} select component_id, k::bigint as k, hz::double as hz, round(psd, 4) as psd from psd")
def welch_psd(spark, sf_dir):
    return psd(spark, sf_dir).select("component_id", F.col("line").cast("bigint").alias("k"), "hz", F.round("psd", 4).alias("psd"))


@query(f"with {TURN} select component_id, event_id, value from tp")
def turning_points(spark, sf_dir):
    return fatigue.turning_points(telemetry(spark, sf_dir), ["component_id"], ["t", "event_id"], "value").select("component_id", "event_id", "value")


@query()
def rainflow_cycles(spark, sf_dir):
    return cycles(spark, sf_dir).select("component_id", r6("range"), r6("mean"), "n")


@query()
def miner_damage(spark, sf_dir):
    return fatigue.miner_damage(cycles(spark, sf_dir), ["component_id"], 3.0, 1e9, 5.0, 5.0)


@query()
def rainflow_features(spark, sf_dir):
    return fatigue.rainflow_features(cycles(spark, sf_dir), ["component_id"])


@query(f"""with {FRAMES}, sl as (select *, lag(hz) over w as h0, lag(psd) over w as p0 from psd window w as (partition by component_id order by k)),
m as (select component_id, sum((psd + p0) / 2 * (hz - h0)) as m0, sum((hz * psd + h0 * p0) / 2 * (hz - h0)) as m1, sum((pow(hz, 2) * psd + pow(h0, 2) * p0) / 2 * (hz - h0)) as m2, sum((pow(hz, 4) * psd + pow(h0, 4) * p0) / 2 * (hz - h0)) as m4 from sl group by 1),
a as (select component_id, m0, sqrt(m2 / m0) as nu0, m1 / sqrt(m0 * m2) as a1, m2 / sqrt(m0 * m4) as a2 from m)
select component_id, round(ln(nu0 * pow(2 * m0, 1.5) * gamma(2.5)), 4) as log_narrow, round(ln(((a1 - a2) * (1.112 * (1 + a1 * a2 - (a1 + a2)) * exp(2.11 * a2) + (a1 - a2)) / pow(a2 - 1, 2) * (1 - a2 * a2) + a2 * a2) * nu0 * pow(2 * m0, 1.5) * gamma(2.5)), 4) as log_tovo from a""")
def spectral_damage(spark, sf_dir):
    d = fatigue.spectral_damage(fatigue.spectral_moments(psd(spark, sf_dir), ["component_id"]), ["component_id"], 3.0)
    return d.select("component_id", F.round(F.log("narrow"), 4).alias("log_narrow"), F.round(F.log("tovo"), 4).alias("log_tovo"))
