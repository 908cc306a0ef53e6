"""Queries of peers, levels, row choices, reports and datasets over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from axlewatch.operators import detect, episodes, features, guards, joins, report, reshape, serve
from axlewatch.plans.alarms import AT, EP, FEATURES, H, MERGE, SPAN, STEP, WF, K, episodes_sql, found, scores, spans, window_features
from axlewatch.plans.registry import query, r6
from axlewatch.plans.streams import shared
from axlewatch.sources import dataset
from axlewatch.sources.bind import DAY_US, FLT, TEL, fault_log, read, telemetry

THRESHOLD = "100 + component_id % 3 * 10"
PER_ROW = f"{TEL}, sc as (select component_id, train_id, t, event_id, value as score, {THRESHOLD} as thr from tel)"


def named_episodes(rows):
    return episodes.episodes_from_scores(rows, "train_id", "component_id", "t", "event_id", "score", "thr", K, MERGE, STEP)


@query(f"""with {PER_ROW}, {episodes_sql('sc', 'train_id, component_id', 'thr')}, {FLT}, m as (select ep.train_id, ep.component_id, ep.episode, ep.t_start, ep.t_end, ep.n_rows, ep.peak, min(fault_id) as fault_id from ep left join flt on flt.component_id = ep.component_id and ep.t_start <= failure and ep.t_end >= onset - {H} group by all)
select train_id || '-' || component_id || '-' || episode as episode_id, t_start, t_end, n_rows, peak, fault_id from m""")
def episodes_from_scores(spark, sf_dir):
    ep = named_episodes(scores(spark, sf_dir).withColumn("thr", F.expr(THRESHOLD)))
    return joins.match_episodes(ep, fault_log(spark, sf_dir), H).select("episode_id", "t_start", "t_end", "n_rows", "peak", "fault_id")


@query(f"""with {PER_ROW.replace('sc as', 'all_sc as')}, {FLT}, sc as (select * from all_sc where not exists (select 1 from flt where flt.component_id = all_sc.component_id and t > failure and t <= failure + {DAY_US})), {episodes_sql('sc', 'train_id, component_id', 'thr')}
select train_id || '-' || component_id || '-' || episode as episode_id, t_start, t_end, n_rows from ep""")
def rebuild_episodes(spark, sf_dir):
    """Episodes anew from published scores, without the rows that follow a failure."""
    rows = joins.blank_post_failure(scores(spark, sf_dir).withColumn("thr", F.expr(THRESHOLD)), fault_log(spark, sf_dir), DAY_US)
    return named_episodes(rows).select("episode_id", "t_start", "t_end", "n_rows")


@query("""with n as materialized (select l_orderkey, l_linenumber, l_quantity, row_number() over () as i from lineitem), p as (select a.i, a.l_orderkey, a.l_linenumber, a.l_quantity as v, avg(b.l_quantity) as m, quantile_cont(b.l_quantity, 0.5) as d from n a left join n b on a.l_orderkey = b.l_orderkey and a.i <> b.i group by 1, 2, 3, 4)
select l_orderkey, l_linenumber, round(coalesce(v - m, 0), 6) as by_mean, round(coalesce(v - d, 0), 6) as by_median from p""")
def peer_delta(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    x = features.peer_delta(features.peer_delta(li, ["l_orderkey"], "l_quantity").withColumnRenamed("peer_delta", "by_mean"), ["l_orderkey"], "l_quantity", "median")
    return x.select("l_orderkey", "l_linenumber", r6("by_mean"), r6("peer_delta", "by_median"))


@query(f"""with {TEL}, e as (select *, value - 50 as e, sum((value - 50 > 30)::int) over (partition by component_id order by t, event_id rows unbounded preceding) as n from tel),
l as (select *, case when value > 200 then 4 when e > 100 then 3 when e > 30 and n >= 10 then 2 when e > 30 then 1 else 0 end as level from e),
m as (select *, coalesce(max(level) over (partition by component_id order by t, event_id rows between unbounded preceding and 1 preceding), 0) as top from l) select event_id, level from m where level > top""")
def alarm_levels(spark, sf_dir):
    return features.alarm_levels(telemetry(spark, sf_dir), ["component_id"], ["t", "event_id"], F.col("value") - 50, F.col("value"), 30, 10, 100, 200).select("event_id", "level")


CH = ["l_quantity", "l_discount", "l_tax"]


@query(f"""with m as (select {', '.join(f'avg({c}) as {c}_mu, stddev_pop({c}) as {c}_sd' for c in CH)} from lineitem where l_linestatus = 'O'), z as (select l_orderkey, sqrt({' + '.join(f'pow(({c} - {c}_mu) / {c}_sd, 2)' for c in CH)}) as l from lineitem, m)
select l_orderkey, round(max(l), 5) as peak, round(avg(l), 5) as mean from z group by 1""")
def det_l2_norm(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return detect.l2_norm(li, li.where("l_linestatus = 'O'"), ["l_orderkey"], CH).select("l_orderkey", F.round("peak", 5).alias("peak"), F.round("mean", 5).alias("mean"))


@query(f"""with recursive {TEL}, c as (select component_id, quantile_cont(value, 0.5) as centre, stddev_pop(value) as sd from tel group by 1), d as (select tel.component_id, any_value(centre) as centre, any_value(sd) as sd, quantile_cont(abs(value - centre), 0.5) * 1.4826 as mad from tel join c using (component_id) group by 1),
o as (select component_id, event_id, abs(value - centre) / case when mad > 0 then mad when sd > 0 then sd else 1 end as z, row_number() over (partition by component_id order by t, event_id) as i from tel join d using (component_id)),
e as (select component_id, event_id, i, z as s from o where i = 1 union all select o.component_id, o.event_id, o.i, e.s * 0.8 + o.z * 0.2 from e join o on o.component_id = e.component_id and o.i = e.i + 1) select event_id, round(s, 5) as score from e""")
def det_robust_z_ewma(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    z = t.join(features.robust_baseline(t, ["component_id"], "value"), "component_id").withColumn("z", F.abs(F.col("value") - F.col("centre")) / F.col("spread"))
    return features.ewma(z, ["component_id"], ["t", "event_id"], "z", 0.2).select("event_id", F.round("ewma", 5).alias("score"))


@query(f"""with {TEL}, m as (select component_id, avg(value) as mu, coalesce(nullif(stddev_pop(value), 0), 1) as sd from tel group by 1), z as (select event_id, component_id, t, (value - mu) / sd as z from tel join m using (component_id)),
p as (select *, sum(z - 0.5) over w as u, sum(-z - 0.5) over w as d from z window w as (partition by component_id order by t, event_id rows unbounded preceding)) select event_id, round(greatest(u - least(0, min(u) over w), d - least(0, min(d) over w)), 4) as score from p window w as (partition by component_id order by t, event_id rows unbounded preceding)""")
def det_cusum_scalar(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    m = t.groupBy("component_id").agg(F.avg("value").alias("mu"), F.coalesce(F.nullif(F.stddev_pop("value"), F.lit(0.0)), F.lit(1.0)).alias("sd"))
    return features.cusum_two_sided(t.join(m, "component_id"), ["component_id"], ["t", "event_id"], (F.col("value") - F.col("mu")) / F.col("sd")).select("event_id", F.round("cusum", 4).alias("score"))


@query(f"with {TEL}, {FLT}, s as (select component_id, min(t) as a, max(t) as b from tel where t < {AT} group by 1) select fault_id from flt join s using (component_id) where onset - {H} <= b and failure >= a")
def events_in_slice(spark, sf_dir):
    return guards.events_in_slice(fault_log(spark, sf_dir), telemetry(spark, sf_dir).where(F.col("t") < AT), "component_id", "t", H).select("fault_id")


@query(f"""with {SPAN}, {FLT}, j as (select sp.component_id, segment, fault_id, (least(t_end, failure) - greatest(t_start, onset)) / nullif(greatest(t_end, failure) - least(t_start, onset), 0)::double as iou from sp join flt on sp.component_id = flt.component_id and t_start <= failure and t_end >= onset),
r as (select *, row_number() over (partition by component_id, segment order by iou desc, fault_id) as r from j where iou >= 0.1) select sp.component_id, sp.segment, fault_id as label, round(iou, 6) as iou from sp left join r on r.component_id = sp.component_id and r.segment = sp.segment and r = 1""")
def label_segments(spark, sf_dir):
    out = guards.label_segments(spans(spark, sf_dir), fault_log(spark, sf_dir), "component_id", ["component_id", "segment"], "fault_id")
    return out.select("component_id", "segment", "label", r6("iou"))


@query(f"with {TEL}, {FLT} select event_id from tel where t >= {AT - 10 * DAY_US} and t < {AT} and not exists (select 1 from flt where flt.component_id = tel.component_id and t between failure - {2 * DAY_US} and failure + {2 * DAY_US})")
def normal_window_guard(spark, sf_dir):
    return guards.normal_window_guard(telemetry(spark, sf_dir), fault_log(spark, sf_dir), "component_id", "t", AT - 10 * DAY_US, AT, 2 * DAY_US).select("event_id")


@query(f"with {TEL}, {FLT}, f as (select component_id, min(onset) as o from flt group by 1) select event_id, coalesce(t >= o, false) as is_faulty from tel left join f using (component_id)")
def extend_labels_to_end(spark, sf_dir):
    return guards.extend_labels_to_end(telemetry(spark, sf_dir), fault_log(spark, sf_dir), "component_id", "t").select("event_id", "is_faulty")


@query("with g as (select c_nationkey, row_number() over (order by md5(c_nationkey::varchar), c_nationkey) as r, count(*) over () as n from (select distinct c_nationkey from customer)) select c_custkey, case when r <= ceil(n * 0.2) then 'val' else 'train' end as part from customer join g using (c_nationkey)")
def carve_rows(spark, sf_dir):
    return guards.carve_rows(read(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", 0.2).select("c_custkey", "part")


@query("with q as (select o_orderkey, o_totalprice > 300000 as faulty from orders), f as (select o_orderkey, row_number() over (order by md5(o_orderkey::varchar), o_orderkey) as r from q where faulty) select o_orderkey from q where not faulty union all select o_orderkey from f where r <= floor((select count(*) from q where not faulty) * 0.05)")
def train_rows(spark, sf_dir):
    q = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") > 300000).alias("faulty"))
    return guards.train_rows(q, "faulty", "o_orderkey", 0.05).select("o_orderkey")


@query("select l_orderkey, count(distinct l_linestatus) as n from lineitem group by 1 having count(distinct l_linestatus) <> 1")
def peer_split_guard(spark, sf_dir):
    return guards.peer_split_guard(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linestatus")


@query(f"with {TEL}, {FLT} select count(*) as n_rows, count(*) filter (where exists (select 1 from flt where flt.component_id = tel.component_id and t between onset - {H} and failure)) as inside from tel where t >= {AT}")
def score_alarm_window(spark, sf_dir):
    return guards.alarm_window_rows(telemetry(spark, sf_dir).where(F.col("t") >= AT), fault_log(spark, sf_dir), "component_id", "t", H)


@query("""with m as (select l_orderkey, l_linenumber, l_discount as a, l_tax as b, l_returnflag as label, false as mirrored from lineitem union all select l_orderkey, l_linenumber, l_tax, l_discount, case l_returnflag when 'A' then 'R' when 'R' then 'A' else l_returnflag end, true from lineitem)
select l_orderkey, l_linenumber, label, mirrored, round(a - b, 6) as lead from m""")
def mirror_rows(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("a"), F.col("l_tax").alias("b"), F.col("l_returnflag").alias("label"))
    m = guards.mirror_rows(li, [("a", "b")], "label", {"A": "R", "R": "A"})
    return m.select("l_orderkey", "l_linenumber", "label", "mirrored", r6(F.col("a") - F.col("b"), "lead"))


@query("""with m as (select greatest(0, 1 - avg(abs(l_quantity * 1500 - l_extendedprice) / abs(l_extendedprice))) as a from lineitem where l_extendedprice <> 0), s as (select s_nationkey, s_suppkey, count(*) over (partition by s_nationkey) as n, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as r, s_suppkey = min(s_suppkey) over (partition by s_nationkey) as y from supplier),
d as (select avg((n - r + 1) / n::double) as b from s where y) select round(a, 6) as mape_score, round(b, 6) as rank_decay, round((a + b) / 2, 6) as combined from m, d""")
def mape_and_rank_decay(spark, sf_dir):
    a = report.mape_score(read(spark, sf_dir, "lineitem").withColumn("guess", F.col("l_quantity") * 1500), "l_extendedprice", "guess")
    s = read(spark, sf_dir, "supplier")
    first = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("true_key"))
    b = report.rank_decay(s.join(first, "s_nationkey"), ["s_nationkey"], "s_acctbal", "s_suppkey", F.col("s_suppkey") == F.col("true_key"))
    return a.join(b).select(r6("mape_score"), r6("rank_decay"), r6((F.col("mape_score") + F.col("rank_decay")) / 2, "combined"))  # one row each


@query("with r as (select s_nationkey, s_suppkey, s_acctbal, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as r from supplier where s_acctbal < 5000) select s_nationkey, s_suppkey, s_acctbal from r where r = 1")
def best_per_population(spark, sf_dir):
    return report.best_per_population(read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), ["s_nationkey"], F.col("s_acctbal") < 5000, "s_acctbal", "s_suppkey")


@query("""select l_returnflag, round(avg(case when l_quantity > 10 then l_discount end) filter (where l_linestatus = 'F'), 6) as F_mean, count(case when l_quantity > 10 then 1 end) filter (where l_linestatus = 'F') as F_finished, count(*) filter (where l_linestatus = 'F') as F_attempted,
round(avg(case when l_quantity > 10 then l_discount end) filter (where l_linestatus = 'O'), 6) as O_mean, count(case when l_quantity > 10 then 1 end) filter (where l_linestatus = 'O') as O_finished, count(*) filter (where l_linestatus = 'O') as O_attempted from lineitem group by 1""")
def ablation_pivot(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").withColumn("metric", F.when(F.col("l_quantity") > 10, F.col("l_discount")))
    p = report.ablation_pivot(li, "l_returnflag", "l_linestatus", ["F", "O"], "metric")
    return p.select("l_returnflag", *[x for s in "FO" for x in (r6(f"{s}_mean"), F.coalesce(f"{s}_finished", F.lit(0)).alias(f"{s}_finished"), F.coalesce(f"{s}_attempted", F.lit(0)).alias(f"{s}_attempted"))])


@query(f"with {WF} select component_id, count(*) as n, {', '.join(f'round(avg({c}), 6) as {c}_mean, round(stddev_samp({c}), 6) as {c}_std, round(min({c}), 6) as {c}_min, round(max({c}), 6) as {c}_max' for c in FEATURES)} from wf group by 1")
def per_test_rollup(spark, sf_dir):
    r = report.rollup(window_features(spark, sf_dir), ["component_id"], FEATURES)
    return r.select("component_id", "n", *[r6(c) for c in r.columns[2:]])


@query(f"""with {EP}, l as (select component_id, train_id, max(t) as t, arg_max(score, t) as score from sc where t <= {AT} group by 1, 2), st as (select *, case when {AT} - t > {DAY_US} then 'ok' when exists (select 1 from ep where ep.component_id = l.component_id and t_start <= {AT} and t_end >= {AT}) then 'crit' when score > 80 then 'warn' else 'ok' end as state from l)
select train_id, count(*) as components, count(*) filter (where state = 'crit') as crit, count(*) filter (where state = 'warn') as warn, max(score) as score from st group by 1""")
def frame_at(spark, sf_dir):
    sc = scores(spark, sf_dir)
    return report.frame_at(serve.component_state_at(sc, found(spark, sf_dir), AT, 100.0, DAY_US), "train_id", sc, "component_id")


@query(f"""with {WF}, m as (select {', '.join(f'avg({c}) as {c}_mu, stddev_pop({c}) as {c}_sd' for c in FEATURES)} from train), z as (select component_id, segment, "window", unnest([struct_pack(i := 0, signal := 'mean', z := (mean - mean_mu) / mean_sd, v := mean), struct_pack(i := 1, signal := 'std', z := (std - std_mu) / std_sd, v := std), struct_pack(i := 2, signal := 'peak', z := (peak - peak_mu) / peak_sd, v := peak)]) as x from wf, m),
r as (select component_id, segment, "window", row_number() over (partition by component_id, segment, "window" order by -abs(x.z), x.i) - 1 as place, x.signal as signal, round(x.z, 4) as z, round(x.v, 4) as value from z) select * from r where place < 2""")
def top_signals_json(spark, sf_dir):
    """Written as JSON and read again."""
    w = window_features(spark, sf_dir)
    m = w.where("component_id % 2 = 0").agg(*[f(c).alias(f"{c}_{n}") for c in FEATURES for n, f in (("mu", F.avg), ("sd", F.stddev_pop))])
    z = {c: (F.col(c) - F.col(f"{c}_mu")) / F.col(f"{c}_sd") for c in FEATURES}
    out = report.top_signals_json(w.join(F.broadcast(m)), z, {c: F.col(c) for c in FEATURES}, 2)  # one row
    out = out.select("component_id", "segment", "window", F.posexplode(report.parse_top_signals(F.col("top_signals"))).alias("place", "x"))
    return out.select("component_id", "segment", "window", "place", F.col("x.signal").alias("signal"), F.round("x.z", 4).alias("z"), F.round("x.value", 4).alias("value"))


@query(f"""with {TEL}, w as (select component_id, train_id, t // {DAY_US} as day, avg(value) filter (where signal = 'click') as click, avg(value) filter (where signal = 'error') as error from tel group by 1, 2, 3), c as (select train_id, t // {DAY_US} as rt, max(value) as context from tel where signal = 'view' group by 1, 2)
select component_id, w.train_id, day, round(click, 6) as click, round(error, 6) as error, context from w asof left join c on w.train_id = c.train_id and w.day >= c.rt""")
def to_wide_context(spark, sf_dir):
    t = telemetry(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY_US))
    long = t.groupBy("component_id", "train_id", "day", "signal").agg(F.avg("value").alias("value"))
    context = t.where("signal = 'view'").groupBy("train_id", F.col("day").alias("rt")).agg(F.max("value").alias("context"))
    return joins.asof_backward(reshape.to_wide(long, ["component_id", "train_id", "day"], "signal", "value", ["click", "error"]), context, ["train_id"], "day", "rt", ["context"]).select("component_id", "train_id", "day", r6("click"), r6("error"), "context")


@query(f"with {TEL} select event_id, component_id, t, value, signal as source, 'run' || train_id as run_id from tel where signal in ('click', 'view') and train_id = 3")
def read_dataset(spark, sf_dir):
    """All telemetry is written as a dataset; one run of two sources is read again."""
    t = telemetry(spark, sf_dir).select("event_id", "component_id", "t", "value", F.col("signal").alias("source"), F.concat(F.lit("run"), F.col("train_id")).alias("run_id"))
    path = f"{shared(spark)}/dataset-{uuid.uuid4().hex}"
    dataset.write_dataset({"telemetry": t}, path)
    return dataset.read_dataset(spark, path, "telemetry", source=["click", "view"], run_id=["run3"])
