"""Queries of thresholds, episodes, metrics, detectors, splits and serving over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from axlewatch.operators import detect, episodes, joins, serve, splits
from axlewatch.operators.ranked import order_statistics, running_sums
from axlewatch.plans.core import SEG, WIN, windowed
from axlewatch.plans.registry import query, r6
from axlewatch.sources.bind import DAY_US, FLT, TEL, fault_log, read, telemetry

THR, K, MERGE, STEP, H = 100.0, 2, 2 * DAY_US, 3 * DAY_US, 3 * DAY_US
AT = 1_705_320_000_000_000  # 2024-01-15 12:00 UTC


def episodes_sql(scored: str, key: str = "component_id", thr: str = "100.0") -> str:
    """Expressions that end in `ep`: K1 over a relation with key, t, event_id and score."""
    return f"""x as (select *, coalesce(score > {thr}, false) as o, row_number() over (partition by {key} order by t, event_id) as p, t - lag(t) over (partition by {key} order by t, event_id) as d from {scored}),
y as (select *, sum(case when o and (not coalesce(lag_o, false) or coalesce(d > {STEP}, false)) then 1 else 0 end) over (partition by {key} order by p rows unbounded preceding) as run from (select *, lag(o) over (partition by {key} order by p) as lag_o from x)),
runs as (select {key}, run, count(*) as n, min(t) as a, max(t) as b, min(p) as pa, max(p) as pb from y where o group by all having count(*) >= {K}),
nw as (select *, case when a - lag(b) over (partition by {key} order by run) < {MERGE} then 0 else 1 end as nw from runs),
es as (select *, sum(nw) over (partition by {key} order by run rows unbounded preceding) - 1 as episode from nw),
sp as (select {key}, episode, min(a) as t_start, max(b) as t_end, min(pa) as pa, max(pb) as pb from es group by all),
ep as (select sp.*, s.n_rows, s.peak from sp, lateral (select count(*) as n_rows, max(score) as peak from x where {' and '.join(f'x.{k.strip()} = sp.{k.strip()}' for k in key.split(','))} and p between pa and pb) s)"""


SC = f"{TEL}, sc as (select component_id, train_id, t, event_id, value as score from tel)"
EP = f"{SC}, {episodes_sql('sc')}"


def scores(spark, sf_dir):
    return telemetry(spark, sf_dir).select("component_id", "train_id", "t", "event_id", F.col("value").alias("score"))


def found(spark, sf_dir):
    return episodes.episodes(scores(spark, sf_dir), ["component_id"], "t", "event_id", F.col("score") > THR, "score", K, MERGE, STEP)


@query(f"with {EP} select component_id, episode::bigint as episode, t_start, t_end, n_rows, peak from ep")
def episodes_k1(spark, sf_dir):
    return found(spark, sf_dir)


@query(f"with {EP} select event_id, exists (select 1 from ep where ep.component_id = x.component_id and x.p between pa and pb) as alert from x")
def alert_flags(spark, sf_dir):
    return episodes.alert_flags(scores(spark, sf_dir), ["component_id"], "t", "event_id", F.col("score") > THR, "score", K, MERGE, STEP).select("event_id", "alert")


MATCH = f"{EP}, {FLT}, m as (select ep.component_id, ep.episode, ep.t_start, ep.t_end, min(fault_id) as fault_id from ep left join flt on flt.component_id = ep.component_id and ep.t_start <= failure and ep.t_end >= onset - {H} group by all)"


@query(f"with {MATCH} select m.component_id, m.episode::bigint as episode, m.t_start, m.t_end, m.fault_id, m.fault_id is not null as matched, round((failure - m.t_start) / 3.6e9, 6) as lead_h from m left join flt on flt.fault_id = m.fault_id")
def match_episodes(spark, sf_dir):
    return joins.match_episodes(found(spark, sf_dir), fault_log(spark, sf_dir), H).select("component_id", "episode", "t_start", "t_end", "fault_id", "matched", r6("lead_h"))


@query(f"with {EP}, {FLT} select fault_id, exists (select 1 from ep where ep.component_id = flt.component_id and t_start <= failure and t_end >= onset - {H}) as detected from flt")
def faults_detected(spark, sf_dir):
    return joins.faults_detected(fault_log(spark, sf_dir), found(spark, sf_dir), H).select("fault_id", "detected")


@query(f"""with {MATCH}, det as (select count(*) as n_faults, sum(case when exists (select 1 from ep where ep.component_id = flt.component_id and t_start <= failure and t_end >= onset - {H}) then 1 else 0 end) as n_detected from flt),
days as (select sum(d) as train_days from (select (max(t) - min(t)) / 8.64e10 as d from sc group by component_id)), fa as (select count(*) as n_false from m where fault_id is null)
select n_faults, n_detected::bigint as n_detected, round(n_detected / nullif(n_faults, 0), 6) as recall, n_false, round(n_false / train_days, 6) as false_per_day from det, days, fa""")
def event_metrics(spark, sf_dir):
    ep, fl = found(spark, sf_dir), fault_log(spark, sf_dir)
    det = joins.faults_detected(fl, ep, H).agg(F.count(F.lit(1)).alias("n_faults"), F.coalesce(F.sum(F.col("detected").cast("long")), F.lit(0)).alias("n_detected"))
    fa = joins.match_episodes(ep, fl, H).agg(F.count(F.when(~F.col("matched"), 1)).alias("n_false"))
    days = episodes.train_days(scores(spark, sf_dir), ["component_id"], "t")
    return det.join(fa).join(days).select("n_faults", "n_detected", r6(F.col("n_detected") / F.nullif(F.col("n_faults"), F.lit(0)), "recall"), "n_false", r6(F.col("n_false") / F.col("train_days"), "false_per_day"))


GRID = 128


@query(f"""with {SC}, lim as (select quantile_cont(score, 0.5) as lo, max(score) as hi from sc), grid as (select i, lo + (hi - lo) * i / {GRID - 1} as thr from lim, unnest(generate_series(0, {GRID - 1})) u(i)),
gs as (select sc.*, i, thr from sc, grid), {episodes_sql('gs', 'i, component_id', 'thr')}, days as (select sum(d) as td from (select (max(t) - min(t)) / 8.64e10 as d from sc group by component_id)),
per as (select grid.i, thr, count(episode) as n_episodes from grid left join sp on sp.i = grid.i group by all)
select i::bigint as step, round(thr, 6) as threshold, n_episodes, n_episodes > td / 7.0 as over_budget, i > coalesce((select max(p2.i) from per p2, days d2 where p2.n_episodes > d2.td / 7.0), -1) as usable from per, days""")
def calibrate_budget(spark, sf_dir):
    out = episodes.calibrate_budget(scores(spark, sf_dir), ["component_id"], "t", "event_id", "score", K, MERGE, STEP, 1 / 7, GRID)
    return out.select(F.col("step").cast("bigint").alias("step"), r6("threshold"), "n_episodes", "over_budget", "usable")


@query("select event_type, round(quantile_cont(value, 0.995), 6) as q995, round(quantile_cont(value, 0.999), 6) as q999 from events group by 1")
def quantile_thresholds(spark, sf_dir):
    return episodes.quantile_thresholds(read(spark, sf_dir, "events"), "value", [0.995, 0.999], ["event_type"]).select("event_type", r6("q995"), r6("q999"))


@query(f"with {TEL}, s as (select t - lag(t) over (partition by component_id order by t, event_id) as step from tel) select round(quantile_cont(step, 0.5) / 1e6, 3) as pitch_s, round(greatest(1.5 * quantile_cont(step, 0.5) / 1e6, quantile_cont(step, 0.5) / 1e6 + 60), 3) as max_step_s from s where step > 0")
def row_pitch(spark, sf_dir):
    p = episodes.row_pitch(telemetry(spark, sf_dir), ["component_id"], "t", "event_id").select((F.col("pitch") / 1e6).alias("p"))
    return p.select(F.round("p", 3).alias("pitch_s"), F.round(F.greatest(1.5 * F.col("p"), F.col("p") + 60), 3).alias("max_step_s"))


@query(f"with {TEL} select round(sum(d), 6) as train_days from (select (max(t) - min(t)) / 8.64e10 as d from tel group by component_id)")
def train_days(spark, sf_dir):
    return episodes.train_days(telemetry(spark, sf_dir), ["component_id"], "t").select(r6("train_days"))


JUDGED = "j as (select length(text) as score, toxic as y from documents join labels using (doc_id))"


def judged(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select(F.length("text").alias("score"), F.col("toxic").alias("y"))


@query(f"with {JUDGED}, r as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as r from j) select round((sum(r) filter (where y = 1) - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2.0) / (count(*) filter (where y = 1) * count(*) filter (where y = 0)), 6) as auroc from r")
def auroc(spark, sf_dir):
    return episodes.auroc(judged(spark, sf_dir), "score", "y").select(r6("auroc"))


@query(f"with {JUDGED}, g as (select score, sum(y) as p, count(*) as c from j group by 1), w as (select p, sum(p) over (order by score desc) / sum(c) over (order by score desc) as prec from g) select round(sum(p * prec) / sum(p), 6) as auprc from w")
def auprc(spark, sf_dir):
    return episodes.auprc(judged(spark, sf_dir), "score", "y").select(r6("auprc"))


@query("""with r as (select l_orderkey, rank() over (partition by l_orderkey order by l_quantity) + (count(*) over (partition by l_orderkey, l_quantity) - 1) / 2.0 as a, rank() over (partition by l_orderkey order by l_linenumber) + (count(*) over (partition by l_orderkey, l_linenumber) - 1) / 2.0 as b from lineitem)
select l_orderkey, round(case when count(*) >= 3 and stddev_pop(a) > 0 and stddev_pop(b) > 0 then covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) end, 6) + 0.0 as rho from r group by 1""")
def monotonicity(spark, sf_dir):
    return episodes.monotonicity(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", "l_linenumber").select("l_orderkey", (r6("rho") + 0.0).alias("rho"))  # no negative zero


@query("with v as (select l_quantity as v, l_returnflag = 'R' as a from lineitem where l_returnflag in ('R', 'N')), g as (select v, count(*) filter (where a) as a, count(*) filter (where not a) as b from v group by 1), w as (select abs(sum(a) over (order by v) / sum(a) over () - sum(b) over (order by v) / sum(b) over ()) as gap from g) select round(max(gap), 6) as ks from w")
def ks_two_sample(spark, sf_dir):
    return episodes.ks_two_sample(read(spark, sf_dir, "lineitem").where("l_returnflag in ('R', 'N')"), "l_quantity", F.col("l_returnflag") == "R").select(r6("ks"))


@query("select round(sqrt(avg(pow(l_extendedprice - l_quantity * 1000, 2))), 4) as rmse, round(avg(abs(l_extendedprice - l_quantity * 1000)), 4) as mae from lineitem")
def rul_errors(spark, sf_dir):
    e = F.col("l_extendedprice") - F.col("l_quantity") * 1000
    return read(spark, sf_dir, "lineitem").agg(F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(F.avg(F.abs(e)), 4).alias("mae"))


@query("""with p as (select l_returnflag as truth, case when l_quantity > 30 then 'R' when l_quantity > 15 then 'N' else 'A' end as guess from lineitem), v as (select unnest(['A', 'N', 'R']) as label),
c as (select label, count(*) filter (where truth = label and guess = label) as tp, count(*) filter (where truth <> label and guess = label) as fp, count(*) filter (where truth = label and guess <> label) as fn from v, p group by 1),
f as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1 from c)
select label, tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, round(avg(f1) over (), 6) as macro_f1, round(avg(recall) filter (where tp + fn > 0) over (), 6) as balanced_accuracy from f""")
def cls_metrics(spark, sf_dir):
    p = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("truth"), F.when(F.col("l_quantity") > 30, "R").when(F.col("l_quantity") > 15, "N").otherwise("A").alias("guess"))
    m = episodes.cls_metrics(p, "truth", "guess", ["A", "N", "R"])
    return m.select("label", "tp", "fp", "fn", *[r6(c) for c in ("precision", "recall", "f1", "macro_f1", "balanced_accuracy")])


# detectors

WF = f"{WIN}, wf as (select component_id, segment, \"window\", max(t) as t, avg(value) as mean, stddev_pop(value) as std, max(value) as peak from win group by 1, 2, 3), train as (select * from wf where component_id % 2 = 0)"


def window_features(spark, sf_dir):
    return windowed(spark, sf_dir).groupBy("component_id", "segment", "window").agg(F.max("t").alias("t"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max("value").alias("peak"))


FEATURES = ["mean", "std", "peak"]


@query(f"""with {WF}, m as (select {', '.join(f'min({x}) as {x}_lo, max({x}) as {x}_hi, quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) as {x}_iqr' for x in FEATURES)} from train)
select component_id, segment, "window", round(greatest(0, {', '.join(f'greatest({x}_lo - {x}, {x} - {x}_hi, 0) / coalesce(nullif({x}_iqr, 0), 1)' for x in FEATURES)}), 6) as score from wf, m""")
def det_sensor_range(spark, sf_dir):
    w = window_features(spark, sf_dir)
    return detect.sensor_range(w, detect.fit_ranges(w.where("component_id % 2 = 0"), FEATURES), FEATURES).select("component_id", "segment", "window", r6("score"))


@query(f"""with {WF}, m as (select {', '.join(f'min({x}) as {x}_lo, max({x}) as {x}_hi, avg({x}) as {x}_mu, stddev_pop({x}) as {x}_sd' for x in FEATURES)} from train)
select component_id, segment, "window", round(({' + '.join(f'({x} < {x}_lo or {x} > {x}_hi)::int' for x in FEATURES)}) / 3.0, 6) as range_share, round(sqrt({' + '.join(f'pow(({x} - {x}_mu) / {x}_sd, 2)' for x in FEATURES)}), 5) as l2, round(greatest({', '.join(f'abs(({x} - {x}_mu) / {x}_sd)' for x in FEATURES)}), 5) as max_z from wf, m""")
def det_trivial_set(spark, sf_dir):
    w = window_features(spark, sf_dir)
    return detect.trivial_set(w, detect.fit_ranges(w.where("component_id % 2 = 0"), FEATURES), FEATURES).select("component_id", "segment", "window", r6("range_share"), F.round("l2", 5).alias("l2"), F.round("max_z", 5).alias("max_z"))


ROB = f"""{WF}, lt as (select feature, v from (select mean, std, peak from train) unpivot (v for feature in (mean, std, peak))), c as (select feature, quantile_cont(v, 0.5) as centre, stddev_pop(v) as sd from lt group by 1),
m as (select lt.feature, any_value(centre) as centre, any_value(sd) as sd, 1.4826 * quantile_cont(abs(v - centre), 0.5) as mad from lt join c using (feature) group by 1),
z as (select component_id, segment, "window", t, abs((v - centre) / case when mad > 0 then mad when sd > 0 then sd else 1 end) as z from (select * from wf unpivot (v for feature in (mean, std, peak))) join m using (feature)),
oz as (select component_id, segment, "window", t, z, row_number() over (partition by component_id, segment, "window" order by z desc) as r from z)"""


def robust(spark, sf_dir):
    w = window_features(spark, sf_dir)
    return detect.robust_scores(w, detect.fit_robust(w.where("component_id % 2 = 0"), FEATURES), ["component_id", "segment", "window", "t"], FEATURES)


@query(f'with {ROB} select component_id, segment, "window", round(max(z), 5) as score, round(avg(z), 5) as mean_z from oz group by 1, 2, 3')
def det_per_channel_or(spark, sf_dir):
    z = robust(spark, sf_dir)
    mean = F.aggregate("z", F.lit(0.0), lambda a, x: a + x) / F.size("z")
    return z.select("component_id", "segment", "window", F.round(F.get("z", F.lit(0)), 5).alias("score"), F.round(mean, 5).alias("mean_z"))


@query(f'with {ROB} select component_id, segment, "window", round(z, 5) as score from oz where r = 2')
def det_k_of_n(spark, sf_dir):
    return robust(spark, sf_dir).select("component_id", "segment", "window", F.round(F.get("z", F.lit(1)), 5).alias("score"))


@query(f'with {WF}, b as (select quantile_cont(std * std, 0.5) as m from train) select component_id, segment, "window", round(std * std / m, 5) as score from wf, b')
def det_window_variance(spark, sf_dir):
    w = window_features(spark, sf_dir)
    return detect.window_variance(w, w.where("component_id % 2 = 0"), "std").select("component_id", "segment", "window", F.round("score", 5).alias("score"))


@query(f'with {WIN}, d as (select component_id, segment, "window", value - lag(value) over (partition by component_id, segment, "window" order by pos) as d from win), s as (select component_id, segment, "window", avg(d * d) as m from d group by 1, 2, 3), b as (select quantile_cont(m, 0.5) as b from s) select component_id, segment, "window", round(m / b, 5) as score from s, b')
def det_squared_diff(spark, sf_dir):
    return detect.squared_diff(windowed(spark, sf_dir), ["component_id", "segment", "window"], "pos", "value").select("component_id", "segment", "window", F.round("score", 5).alias("score"))


@query(f'with {WF} select component_id, segment, "window", round(-peak, 6) as score from wf')
def det_single_feature(spark, sf_dir):
    return window_features(spark, sf_dir).select("component_id", "segment", "window", r6(-F.col("peak"), "score"))


@query("with s as (select vec_id, embedding from embeddings order by md5(vec_id::varchar), vec_id limit 500) select e.vec_id, round(min(list_distance(e.embedding::double[], s.embedding::double[])), 4) as score from embeddings e, s where e.vec_id <> s.vec_id group by 1")
def det_nn1(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return detect.nearest(e, e, "vec_id", "vec_id", "embedding").select("vec_id", F.round("score", 4).alias("score"))


@query("with s as (select vec_id, embedding from embeddings order by md5(vec_id::varchar), vec_id limit 500), d as (select e.vec_id, list_distance(e.embedding::double[], s.embedding::double[]) as d, row_number() over (partition by e.vec_id order by list_distance(e.embedding::double[], s.embedding::double[])) as r from embeddings e, s where e.vec_id <> s.vec_id) select vec_id, round(d, 4) as score from d where r = 5")
def det_knn(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return detect.nearest(e, e, "vec_id", "vec_id", "embedding", 5).select("vec_id", F.round("score", 4).alias("score"))


@query(f"""with {WF}, l as (select component_id, segment, "window", feature, round(v, 9) as v from wf unpivot (v for feature in (mean, std, peak))), mm as (select *, avg(v) over (partition by feature) as mu from l),
k as (select feature, count(*) as n, avg(pow(v - mu, 3)) as skew from mm group by 1), t as (select component_id, segment, "window", l.feature, -ln(cume_dist() over (partition by l.feature order by v)) as lf, -ln(cume_dist() over (partition by l.feature order by v desc)) as rt, skew from l join k using (feature))
select component_id, segment, "window", round(greatest(sum(lf), sum(rt), sum(case when skew < 0 then lf else rt end)), 5) as score from t group by all""")
def det_ecod(spark, sf_dir):
    w = window_features(spark, sf_dir).withColumns({c: F.round(c, 9) for c in FEATURES})  # equal windows tie whatever the order of their sums
    e = detect.ecod(w, ["component_id", "segment", "window"], FEATURES)
    return e.select("component_id", "segment", "window", F.round("score", 5).alias("score"))


@query(f"with {TEL}, cal as (select value as s from tel where component_id % 5 = 0), n as (select count(*) as n from cal) select event_id, round(1 - (1 + (select count(*) from cal where s >= value)) / (1 + n), 6) as p_alarm from tel, n where component_id % 5 <> 0")
def det_conformal(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return detect.conformal(t.where("component_id % 5 <> 0").select("event_id", "value"), t.where("component_id % 5 = 0"), "value").select("event_id", r6("p_alarm"))


# splits

SPAN = f"{SEG}, sp as (select component_id, segment, min(t) as t_start, max(t) as t_end from seg group by 1, 2)"


def spans(spark, sf_dir):
    from axlewatch.plans.core import segmented

    return segmented(spark, sf_dir).groupBy("component_id", "segment").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"))


def part_sql(v: str, t: str) -> str:
    return f"case when t_end < {v} then 'train' when t_start >= {v} and t_end < {t} then 'val' when t_start >= {t} then 'test' else 'none' end as part"


@query(f"with {SPAN} select component_id, segment, {part_sql(str(AT), str(AT + 5 * DAY_US))} from sp")
def temporal_split(spark, sf_dir):
    return splits.temporal_split(spans(spark, sf_dir), "t_start", "t_end", F.lit(AT), F.lit(AT + 5 * DAY_US)).select("component_id", "segment", "part")


@query(f"with {SPAN} select component_id, segment, min(t_start) over (partition by component_id % 10) as t_start, max(t_end) over (partition by component_id % 10) as t_end from sp")
def peer_atomic_support(spark, sf_dir):
    return splits.peer_atomic_support(spans(spark, sf_dir).withColumn("g", F.col("component_id") % 10), ["g"], "t_start", "t_end").select("component_id", "segment", "t_start", "t_end")


@query(f"with {SPAN}, c as (select quantile_cont(t_start, 0.6) as v, quantile_cont(t_start, 0.8) as w from sp) select component_id, segment, {part_sql('v', 'w')} from sp, c")
def fraction_split(spark, sf_dir):
    return splits.fraction_split(spans(spark, sf_dir), "t_start", "t_end").select("component_id", "segment", "part")


@query("with g as (select distinct c_nationkey as fold from customer) select c_custkey, fold, case when fold = c_nationkey then 'test' else 'train' end as part from customer, g")
def leave_one_group_out(spark, sf_dir):
    return splits.leave_one_group_out(read(spark, sf_dir, "customer"), "c_nationkey").select("c_custkey", "fold", "part")


@query("with g as (select c_nationkey, row_number() over (order by md5('s1' || c_nationkey)) as r from (select distinct c_nationkey from customer)) select c_custkey, case when r <= 3 then 'test' when r <= 6 then 'val' else 'train' end as part from customer join g using (c_nationkey)")
def random_group_holdout(spark, sf_dir):
    return splits.group_holdout(read(spark, sf_dir, "customer"), "c_nationkey", "s1", 3, 3).select("c_custkey", "part")


@query("with g as (select c_nationkey, row_number() over (order by c_nationkey) - 1 as r from (select distinct c_nationkey from customer)) select c_custkey, case when r >= 20 then 'test' when r >= 15 then 'val' else 'train' end as part from customer join g using (c_nationkey)")
def rank_of_group_split(spark, sf_dir):
    return splits.rank_of_group_split(read(spark, sf_dir, "customer"), "c_nationkey", 15, 20).select("c_custkey", "part")


# serving


@query(f"with {EP}, l as (select component_id, max(t) as t, arg_max(score, t) as score from sc where t <= {AT} group by 1) select component_id, t, score, case when {AT} - t > 86400000000 then 'ok' when exists (select 1 from ep where ep.component_id = l.component_id and t_start <= {AT} and t_end >= {AT}) then 'crit' when score > 80 then 'warn' else 'ok' end as state from l")
def component_state_at(spark, sf_dir):
    return serve.component_state_at(scores(spark, sf_dir), found(spark, sf_dir), AT, THR, DAY_US)


@query(f"with {EP} select ep.component_id, episode::bigint as episode, t_start, case when t_end <= {AT} then t_end end as t_end, (select max(score) from sc where sc.component_id = ep.component_id and t between t_start and t_end and t <= {AT}) as peak from ep where t_start <= {AT} order by t_start desc, ep.component_id limit 25")
def alerts_at(spark, sf_dir):
    return serve.alerts_at(found(spark, sf_dir), scores(spark, sf_dir), AT)


@query(f"with {EP}, tr as (select component_id, episode::bigint as episode, t_start as t, 'open' as what from ep union all select component_id, episode::bigint, t_end, 'close' from ep) select * from tr where t <= {AT} order by t desc, component_id, what limit 20")
def ticker_at(spark, sf_dir):
    return serve.ticker_at(found(spark, sf_dir), AT)


@query(f"with {MATCH}, o as (select count(*) filter (where t_start <= {AT} and t_end >= {AT}) as open_now, count(*) filter (where t_start <= {AT}) as opened, round(quantile_cont((failure - t_start) / 3.6e9, 0.5) filter (where t_end <= {AT}), 6) as median_lead_h from m left join flt on flt.fault_id = m.fault_id) select * from o")
def kpis_at(spark, sf_dir):
    m = joins.match_episodes(found(spark, sf_dir), fault_log(spark, sf_dir), H)
    a, z = F.col("t_start") <= AT, F.col("t_end")
    lead = order_statistics(m.where(z <= AT), "lead_h", {"median_lead_h": 0.5}).select(r6("median_lead_h"))
    return m.agg(F.count(F.when(a & (z >= AT), 1)).alias("open_now"), F.count(F.when(a, 1)).alias("opened")).join(lead)  # one row each


@query(f"""with {TEL}, b0 as (select *, row_number() over (partition by component_id order by t) - 1 as p, count(*) over (partition by component_id) as n from tel), b as (select *, case when n <= 20 then p else p * 10 // n end as b from b0),
r as (select component_id, b, t, value, row_number() over (partition by component_id, b order by value, t) as lo, row_number() over (partition by component_id, b order by value desc, t) as hi from b) select component_id, t, value from r where lo = 1 or hi = 1""")
def series_minmax(spark, sf_dir):
    return serve.series_minmax(telemetry(spark, sf_dir).select("component_id", "t", "value"), ["component_id"], "t", "value", 20)


@query(f"with {TEL}, r as (select *, row_number() over (partition by component_id order by t desc, event_id desc) as r from tel where t <= {AT}) select component_id, event_id, t from r where r <= 5")
def recent_events(spark, sf_dir):
    return serve.recent_events(telemetry(spark, sf_dir), AT, 5, "component_id").select("component_id", "event_id", "t")


@query(f"with {TEL} select event_id, t, value as score from tel where component_id = 11 and t between {AT} - 864000000000 and {AT}")
def score_points(spark, sf_dir):
    return telemetry(spark, sf_dir).where((F.col("component_id") == 11) & F.col("t").between(AT - 10 * DAY_US, AT)).select("event_id", "t", F.col("value").alias("score"))


@query(f"with {TEL}, l as (select component_id, train_id, arg_max(value, t) as score from tel where t <= {AT} group by 1, 2) select component_id, rank() over (order by score desc) as rank, round(quantile_cont(score, 0.5) over (), 6) as median, round(quantile_cont(score, 0.9) over (), 6) as p90 from l")
def rank_peers(spark, sf_dir):
    last = telemetry(spark, sf_dir).where(F.col("t") <= AT).groupBy("component_id").agg(F.max_by("value", "t").alias("score"))
    q = order_statistics(last, "score", {"median": 0.5, "p90": 0.9}).select(r6("median"), r6("p90"))
    counts = last.groupBy((-F.col("score")).alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    ranks = running_sums(counts, ["_s"], {"_upto": F.col("_c")}).select("_s", (F.col("_upto") - F.col("_c") + 1).cast("int").alias("rank"))
    return last.join(ranks, -F.col("score") == F.col("_s")).join(F.broadcast(q)).select("component_id", "rank", "median", "p90")


@query(f"with {EP}, al as (select component_id, t, event_id from sc where score > 150) select event_id from al where not exists (select 1 from ep where ep.component_id = al.component_id and al.t between t_start and t_end)")
def scores_audit(spark, sf_dir):
    high = joins.reached(scores(spark, sf_dir).where("score > 150"), found(spark, sf_dir), ["component_id"], F.col("t"), F.col("t_start"), F.col("t_end"))
    return high.where(~F.coalesce(F.col("_reach") >= F.col("t"), F.lit(False))).select("event_id")


# flagship

FLAG_THR = "(select quantile_cont(score, 0.8) from zs)"
FLAG = f"""{ROB}, {FLT}, zs as (select component_id, segment, "window" as event_id, t, max(z) as score from oz group by 1, 2, 3, 4), {episodes_sql('zs', 'component_id', FLAG_THR)}"""


@query(f"""with {FLAG}, mt as (select ep.component_id, ep.episode, ep.t_start, ep.t_end, ep.n_rows, min(fault_id) as fault_id from ep left join flt on flt.component_id = ep.component_id and ep.t_start <= failure and ep.t_end >= onset - {H} group by all)
select component_id, episode::bigint as episode, t_start, t_end, n_rows, fault_id, fault_id is not null as matched from mt""")
def alarm_episodes_of_components(spark, sf_dir):
    """Which components had alarm episodes, and did each precede a fault? gaps -> windows -> robust z -> threshold -> episodes -> faults."""
    z = robust(spark, sf_dir).select("component_id", F.col("window").alias("event_id"), "t", F.get("z", F.lit(0)).alias("score"))
    thr = F.broadcast(order_statistics(z, "score", {"thr": 0.8}))  # one row
    ep = episodes.episodes(z.join(thr), ["component_id"], "t", "event_id", F.col("score") > F.col("thr"), "score", K, MERGE, STEP)
    return joins.match_episodes(ep, fault_log(spark, sf_dir), H).select("component_id", "episode", "t_start", "t_end", "n_rows", "fault_id", "matched")


