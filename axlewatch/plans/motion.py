"""Queries of segments by an automaton, adaptive drift windows, distance and wavelength over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from axlewatch.operators import adaptive, automaton, order_track
from axlewatch.plans.alarms import K, MERGE, STEP, THR, episodes_sql
from axlewatch.plans.registry import query, r6
from axlewatch.plans.streams import drained, events, rocks
from axlewatch.sources.bind import DAY_US, TEL, telemetry
from axlewatch.streaming import alarms, prefix

WEEK = 7 * DAY_US


def automaton_sql(source: str, key: str) -> str:
    """Common table expressions from `source`(key, t, event_id, x, c) to `marked`(key, event_id, segment), row by row."""
    return f"""o as materialized (select *, row_number() over (partition by {key} order by t, event_id) as n from (select {key}, t, event_id, c, x as raw from {source})),
f as materialized (select o.*, coalesce(last_value(raw ignore nulls) over (partition by {key} order by n rows unbounded preceding), first_value(raw ignore nulls) over (partition by {key} order by n rows between current row and unbounded following)) as p, n > 1 and c is distinct from lag(c) over (partition by {key} order by n) as e,
greatest(0.08::double * (max(raw) over (partition by {key}) - min(raw) over (partition by {key})), 1) as band, greatest(0.5::double * (max(raw) over (partition by {key}) - min(raw) over (partition by {key})), 1) as need from o),
a as (select {key}, n, p as anchor, p as extreme, 0 as way, true as cut from f where n = 1
union all select {key}, n, case when cut_now then p else anchor end, case when cut_now then p when way = 0 and abs(p - anchor) > band then p when way <> 0 and (p - extreme) * way > 0 then p else extreme end, case when cut_now then 0 when way = 0 and abs(p - anchor) > band then case when p > anchor then 1 else -1 end else way end, cut_now
from (select {', '.join(f'f.{k.strip()}' for k in key.split(','))}, f.n, f.p, band, anchor, extreme, way, e or (way <> 0 and (p - extreme) * way <= 0 and (extreme - p) * way > band and abs(extreme - anchor) >= need) as cut_now from a join f on f.n = a.n + 1 and {' and '.join(f'f.{k.strip()} = a.{k.strip()}' for k in key.split(','))})),
s as (select {key}, n, lead(n) over (partition by {key} order by n) as following from a where cut), k as (select {key}, max(n) as total from f group by all),
w as (select s.*, s.n = 1 or coalesce(following, total + 1) - s.n >= 4 as fresh from s join k using ({key})),
marked as (select f.{key.split(',')[0]}, f.event_id, sum(case when coalesce(fresh, false) then 1 else 0 end) over (partition by {', '.join(f'f.{k.strip()}' for k in key.split(','))} order by f.n rows unbounded preceding) - 1 as segment{''.join(f', f.{k.strip()}' for k in key.split(',')[1:])} from f left join w on {' and '.join(f'w.{k.strip()} = f.{k.strip()}' for k in key.split(','))} and w.n = f.n)"""


def moves(spark, sf_dir):
    """Readings as positions; a new week is a new command."""
    return telemetry(spark, sf_dir).select("component_id", "t", "event_id", "value", F.floor(F.col("t") / WEEK).alias("week"))


@query(f"with recursive {TEL}, src as (select component_id, t, event_id, value as x, t // {WEEK} as c from tel), {automaton_sql('src', 'component_id')} select event_id, segment::bigint as segment from marked")
def state_machine_segments(spark, sf_dir):
    out = automaton.state_segments(moves(spark, sf_dir), ["component_id"], "t", "event_id", "value", "week", min_rows=4, block=16)
    return out.select("event_id", F.col("segment").cast("long").alias("segment"))


@query(f"""with recursive {TEL}, g as (select *, sum(case when d > 172800000000 then 1 else 0 end) over (partition by component_id order by t, event_id rows unbounded preceding) as gap from (select *, t - lag(t) over (partition by component_id order by t, event_id) as d from tel)),
src as (select component_id, gap, t, event_id, value as x, t // {WEEK} as c from g), {automaton_sql('src', 'component_id, gap')}, ks as (select component_id, gap, max(segment) + 1 as held from marked group by all), ah as (select component_id, gap, coalesce(sum(held) over (partition by component_id order by gap rows between unbounded preceding and 1 preceding), 0) as ahead from ks)
select event_id, (segment + ahead)::bigint as segment from marked join ah using (component_id, gap)""")
def hybrid_segments(spark, sf_dir):
    out = automaton.cycle_segments(moves(spark, sf_dir), ["component_id"], "t", "event_id", "value", "week", max_gap=2 * DAY_US, method="hybrid", min_rows=4)
    return out.select("event_id", F.col("segment").cast("long").alias("segment"))


def calm_start(spark, sf_dir, rows: int = 20):
    """Readings with the mean and deviation of their series' first rows."""
    w = Window.partitionBy("component_id").orderBy("t", "event_id")
    first = F.when(F.row_number().over(w) <= rows, F.col("value"))
    t = telemetry(spark, sf_dir).withColumn("_first", first)
    whole = Window.partitionBy("component_id")
    return t.withColumns({"centre": F.round(F.avg("_first").over(whole), 6), "scale": F.round(F.stddev_samp("_first").over(whole), 6)}).drop("_first")


@query()
def adwin_drift(spark, sf_dir):
    """How far has the adaptive mean of each component moved from its first readings?"""
    a = adaptive.adwin(calm_start(spark, sf_dir), ["component_id"], ["t", "event_id"], "value", F.col("centre"), F.col("scale"), clock=4)
    return a.select("component_id", "event_id", F.round("evidence", 6).alias("evidence"), "drift")


@query()
def kswin_drift(spark, sf_dir):
    k = adaptive.kswin(telemetry(spark, sf_dir), ["component_id"], ["t", "event_id"], "value", window=40, latest=12)
    return k.select("component_id", "event_id", F.round("evidence", 6).alias("evidence"), "drift")


@query()
def det_adwin(spark, sf_dir):
    """Half the evidence of the adaptive mean and half that of the two-sample test, on robust residuals."""
    t = telemetry(spark, sf_dir)
    whole = Window.partitionBy("component_id")
    middle = F.percentile("value", 0.5).over(whole)
    r = t.withColumn("_d", F.abs(F.col("value") - middle)).withColumn("residual", (F.col("value") - middle) / F.greatest(1.4826 * F.percentile("_d", 0.5).over(whole), F.lit(1e-9)))
    a = adaptive.adwin(r, ["component_id"], ["t", "event_id"], "residual", clock=4)
    k = adaptive.kswin(r, ["component_id"], ["t", "event_id"], "residual", window=40, latest=12).select(F.col("event_id").alias("e"), F.col("evidence").alias("other"), F.col("drift").alias("also"))
    return a.join(k, F.col("event_id") == F.col("e")).select("component_id", "event_id", F.round((F.col("evidence") + F.col("other")) / 2, 6).alias("score"), (F.col("drift") | F.col("also")).alias("drift"))


@query(f"""with {TEL}, m as (select *, value > 150 as hit, max(t) filter (where value > 150) over w as seen, sum(case when value > 150 then 1 else 0 end) over w as n, sum(case when value > 150 then 1 else 0 end) over (partition by component_id) as total,
min(value) over (partition by component_id) as low, max(value) over (partition by component_id) as high from tel window w as (partition by component_id order by t, event_id rows unbounded preceding))
select event_id, round(coalesce(exp(-(t - seen) / {float(2 * DAY_US)}::double), 0), 6) as near, round(case when high > low then (value - low) / (high - low) else 0 end, 6) as curve01, round(coalesce(n / nullif(total, 0)::double, 0), 6) as count01 from m""")
def cpd_score(spark, sf_dir):
    c = adaptive.change_scores(telemetry(spark, sf_dir).withColumn("hit", F.col("value") > 150), ["component_id"], "t", "event_id", "hit", "value", float(2 * DAY_US))
    return c.select("event_id", r6("near"), r6("curve01"), r6("count01"))


@query(f"""with {TEL}, wm as (select (max(t) // 1000 - 86400000) * 1000 as w from tel), sc as (select component_id, t, event_id, value as score from tel, wm where t <= w), {episodes_sql('sc')},
final as (select component_id, run from y qualify o and row_number() over (partition by component_id order by p desc) = 1), tr as (select component_id, count(*) as n, min(t) as a from y join final using (component_id, run) where o group by 1),
l as (select component_id, max(t) as l from sc group by 1), nx as (select ep.*, lead(t_start) over (partition by component_id order by episode) is not null as followed from ep)
select component_id, episode::bigint as episode, t_start, t_end, n_rows, peak from nx join l using (component_id) left join tr using (component_id), wm
where followed or (w >= t_end + {MERGE} and not coalesce(tr.n >= {K} and w < l + {STEP} + 1, false) and not coalesce(tr.n < {K} and tr.a - t_end < {MERGE} and w - l <= {STEP}, false))""")
def stream_episodes(spark, sf_dir):
    """Episodes that are over once the watermark stands a day before the last event."""
    with rocks(spark):
        return drained(spark, alarms.stream_episodes(events(spark, sf_dir), THR, K, MERGE, STEP), "append")


# distance and wavelength: a component's readings in order of time are its recording, readings above 50 its pulse

DX, POINTS, TOOTH = 0.25, 16, 1.0
WAVES, CENTRES = order_track.log_wavelengths(0.5, 4.0, 24), order_track.third_octaves(0.75, 3.0)
TRACK = f"""{TEL}, pl as (select component_id, event_id, value, row_number() over (partition by component_id order by t, event_id) - 1 as place, case when value > 50 then 1 else 0 end as p from tel),
ed as (select *, p <> lag(p) over (partition by component_id order by place) as edge from pl), kk as (select *, sum(case when edge then 1 else 0 end) over (partition by component_id order by place rows unbounded preceding) as k from ed),
ab as (select *, max(case when edge then place end) over (partition by component_id order by place rows unbounded preceding) as a, min(case when edge then place end) over (partition by component_id order by place rows between current row and unbounded following) as b, max(k) over (partition by component_id) as n from kk),
ez as (select *, max(case when edge and k = 1 then place end) over c as e1, max(case when edge and k = 2 then place end) over c as e2, max(case when edge and k = n - 1 then place end) over c as ey, max(case when edge and k = n then place end) over c as ez from ab window c as (partition by component_id)),
ds as (select *, {TOOTH}::double * case when n < 2 then 0 when k = 0 then -(e1 - place) / (e2 - e1)::double when b is null then n - 1 + (place - ez) / (ez - ey)::double else k - 1 + case when b > a then (place - a) / (b - a)::double else 0 end end as d0 from ez),
di as (select component_id, event_id, place, value, d0 - first_value(d0) over (partition by component_id order by place) as distance from ds)"""
GRID_SQL = f"""{TRACK}, uq as (select component_id, distance as d, arg_max(value, place) as v from di where value is not null group by 1, 2), sp as (select component_id, max(d) as far, min(d) as near from uq group by 1 having max(d) - min(d) > {4 * DX}),
gr as (select component_id, unnest(generate_series(ceil(near / {DX})::bigint, floor(far / {DX})::bigint)) as j from sp), lf as (select gr.component_id, j, max(d) as ld from gr join uq on uq.component_id = gr.component_id and d <= j * {DX} group by 1, 2), rt as (select gr.component_id, j, min(d) as rd from gr join uq on uq.component_id = gr.component_id and d >= j * {DX} group by 1, 2),
rs as (select lf.component_id, lf.j, case when coalesce(rd, ld) > ld then l.v + (r.v - l.v) * (lf.j * {DX} - ld) / (rd - ld) else l.v end as x from lf left join rt using (component_id, j) join uq l on l.component_id = lf.component_id and l.d = ld left join uq r on r.component_id = lf.component_id and r.d = rd)"""
WAVE_SQL = f"""{GRID_SQL}, q as (select component_id, x, row_number() over (partition by component_id order by j) - 1 as p, count(*) over (partition by component_id) as n from rs),
fr as (select component_id, w, p - w * {POINTS // 2} as pos, x - avg(x) over (partition by component_id, w) as v from q, unnest(generate_series(0, (n - {POINTS}) // {POINTS // 2})) u(w) where n >= {POINTS} and p between w * {POINTS // 2} and w * {POINTS // 2} + {POINTS - 1}),
hn as (select i, 0.5 - 0.5 * cos(2 * pi() * i / {POINTS}) as h from generate_series(0, {POINTS - 1}) g(i)), ks as (select k from generate_series(2, {POINTS // 2}) g(k)),
ft as (select component_id, w, k, pow(sum(v * h * cos(2 * pi() * k * pos / {POINTS})), 2) + pow(sum(v * h * sin(2 * pi() * k * pos / {POINTS})), 2) as power from fr join hn on hn.i = fr.pos, ks group by 1, 2, 3),
ps as (select component_id, {POINTS * DX} / k as w, 10 * log10(greatest(avg(power * case when k = {POINTS // 2} then 1 else 2 end / (select sum(h * h) from hn) * {DX}), 1e-20)) as db from ft group by 1, k),
wv as (select unnest([{', '.join(repr(w) for w in WAVES)}]::double[]) as wavelength), br as (select component_id, wavelength, arg_max(struct_pack(w := w, db := db), w) filter (where w <= wavelength) as l0, arg_min(struct_pack(w := w, db := db), w) filter (where w >= wavelength) as r0 from ps, wv group by 1, 2),
sd as (select component_id, wavelength, l.db + case when r.w > l.w then (r.db - l.db) * (wavelength - l.w) / (r.w - l.w) else 0 end as db from (select component_id, wavelength, coalesce(l0, r0) as l, coalesce(r0, l0) as r from br))"""


def tracked(spark, sf_dir):
    return order_track.pulse_distance(telemetry(spark, sf_dir), ["component_id"], ["t", "event_id"], F.col("value") > 50, TOOTH)


def gridded(spark, sf_dir):
    return order_track.resampled(tracked(spark, sf_dir), ["component_id"], "distance", "place", "value", DX)


def waves(spark, sf_dir):
    return order_track.wavelength_spectrum(gridded(spark, sf_dir), ["component_id"], DX, POINTS, WAVES)


@query(f"with {TRACK} select event_id, round(distance, 6) as distance from di")
def pulse_distance(spark, sf_dir):
    return tracked(spark, sf_dir).select("event_id", r6("distance"))


@query(f"with {GRID_SQL} select component_id, j, round(x, 6) as x from rs")
def distance_resample(spark, sf_dir):
    return gridded(spark, sf_dir).select("component_id", "j", r6("x"))


@query(f"with {WAVE_SQL} select component_id, round(wavelength, 6) as wavelength, round(db, 4) as db from sd")
def wavelength_spectrum(spark, sf_dir):
    return waves(spark, sf_dir).select("component_id", r6("wavelength"), F.round("db", 4).alias("db"))


@query(f"""with {WAVE_SQL}, ce as (select unnest([{', '.join(repr(c) for c in CENTRES)}]::double[]) as centre) select component_id, round(centre, 6) as centre, round(10 * log10(greatest(avg(pow(10, db / 10)), 1e-20)), 4) as db
from sd, ce where wavelength >= centre * pow(2, -1 / 6.0::double) and wavelength < centre * pow(2, 1 / 6.0::double) group by 1, 2""")
def wavelength_bands(spark, sf_dir):
    return order_track.band_levels(waves(spark, sf_dir), ["component_id"], CENTRES, WAVES).select("component_id", r6("centre"), F.round("db", 4).alias("db"))


@query()
def stream_prefix_damage(spark, sf_dir):
    d = drained(spark, prefix.stream_prefix_damage(events(spark, sf_dir), 3.0, 1e9), "append")
    return d.select("component_id", "event_id", "cycles", F.round("damage", 9).alias("damage"))


@query(f"""with {TEL}, e as (select *, coalesce(value > 50, false) <> lag(coalesce(value > 50, false)) over w as edge, t - min(t) over (partition by component_id) as s from tel window w as (partition by component_id order by t, event_id)),
n as (select *, sum(case when edge then 1 else 0 end) over (partition by component_id order by t, event_id rows unbounded preceding) as edges from e) select event_id, edges::bigint as edges, round(edges / 2.0::double * 1000000 / nullif(s / 1e6::double, 0), 6) as speed, edges >= 5 as ready from n""")
def stream_prefix_speed(spark, sf_dir):
    s = drained(spark, prefix.stream_prefix_speed(events(spark, sf_dir), 50.0, 1e6, 5), "append")
    return s.select("event_id", "edges", r6("speed"), "ready")
