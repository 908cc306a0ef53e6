"""Queries of range-aware metrics, drift, peers, saloons, records and folds over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from axlewatch.operators import detect, drift, features, intervals, peers, report, saloon, segments, serve, splits, volume
from axlewatch.plans.alarms import AT, EP, found, scores
from axlewatch.plans.registry import query, r6
from axlewatch.plans.streams import drained, events
from axlewatch.sources.bind import DAY_US, FLT, TEL, fault_log, read, telemetry
from axlewatch.streaming import streams

BUFFER, GRID = 10, 250


@query(f"""with r as materialized (select value as score, day(ts) in (5, 6, 12, 20, 21) as y, row_number() over (order by ts, event_id) - 1 as p from events where value is not null and not isnan(value)), n as (select count(*) as n, count(*) filter (where y) as pos from r),
g as (select unnest(range(0, least({GRID}, n))) as k, least({GRID}, n) - 1 as steps, n from n), d as (select score, row_number() over (order by score desc) - 1 as i from r), th as materialized (select k, score as thr from g join d on i = k * (n - 1) // steps),
np as materialized (select k, count(*) as pred, count(*) filter (where y) as hit from th join r on score >= thr group by 1), seq as materialized (select min(p) as s, max(p) as e from (select p, p - row_number() over (order by p) as g from r where y) group by g),
ws as (select unnest(range(0, {BUFFER + 1})) as w), near as materialized (select p, score, case when p < s then s - p else p - e end as d from r join seq on p between s - {BUFFER // 2} and e + {BUFFER // 2} where not y),
ext as (select w, p, score, least(1, sum(sqrt(1 - d / w::double))) as x from ws join near on d <= w // 2 group by 1, 2, 3), soft as (select w, k, sum(x) as x from ext join th on score >= thr group by 1, 2),
sg as (select w, s, e, case when lag(e) over (partition by w order by s) + w // 2 >= s - w // 2 then 0 else 1 end as apart from ws, seq), sm as (select *, sum(apart) over (partition by w order by s rows unbounded preceding) as m from sg),
lw as (select w, m, min(s) - w // 2 as a, max(e) + w // 2 as b from sm group by 1, 2), top as (select w, m, max(score) as score from lw join r on p between a and b group by 1, 2), ex as (select w, k, count(*) as found from top join th on score >= thr group by 1, 2), nl as (select w, count(*) as n_all from lw group by 1),
c as (select w, k, least((hit + coalesce(x, 0)) / (pos + coalesce(x, 0) / 2), 1) * coalesce(found, 0) / n_all as rc, (hit + coalesce(x, 0)) / pred as q from ws cross join np cross join n join nl using (w) left join soft using (w, k) left join ex using (w, k)),
a as (select w, sum(da) as a from (select w, (rc - coalesce(lag(rc) over (partition by w order by k), 0)) * q as da from c) group by 1) select round(avg(a), 6) as vus_pr from a""")
def vus_pr(spark, sf_dir):
    """Do great readings tell five days of a month apart?"""
    e = read(spark, sf_dir, "events").withColumn("y", F.dayofmonth("ts").isin(5, 6, 12, 20, 21))
    return volume.vus_pr(e, ["ts", "event_id"], "value", "y", BUFFER, GRID).select(r6("vus_pr"))


PH = """with recursive {tel}, o as (select component_id, event_id, coalesce(value, 'nan'::double) as x, row_number() over (partition by component_id order by t, event_id) as i from tel),
z as (select distinct component_id, null::bigint as event_id, 0::bigint as i, 0::bigint as n, 0::double as mean, 0::double as up, 0::double as dn, 'inf'::double as lo, (-1)::double as hi, 0::double as base, 0::double as top, false as drift from o),
e as (select * from z union all select component_id, event_id, i, n, mean, up, dn, lo, hi, case when now > 200 then base + 200 else base end, greatest(top, base + now), now > 200 from
(select *, case when n >= 10 then greatest(up - lo, hi - dn) else 0 end as now from (select *, least(lo0, up) as lo, greatest(hi0, dn) as hi from (select *, 0.9999::double * up0 + (x - mean) - 0.005::double as up, 0.9999::double * dn0 + (x - mean) + 0.005::double as dn from (select *, mean0 + (x - mean0) / n as mean from
(select o.component_id, o.event_id, o.i, case when drift then 1 else n + 1 end as n, case when drift then 0 else mean end as mean0, case when drift then 0 else up end as up0, case when drift then 0 else dn end as dn0, case when drift then 'inf'::double else lo end as lo0, case when drift then -1 else hi end as hi0,
base, top, case when isnan(x) then case when drift then 0 else mean end else x end as x from e join o on o.component_id = e.component_id and o.i = e.i + 1))))))
select event_id, round(top, 4) as evidence, drift from e where i > 0""".format(tel=TEL)


@query(PH)
def page_hinkley(spark, sf_dir):
    p = drift.page_hinkley(telemetry(spark, sf_dir), ["component_id"], ["t", "event_id"], "value", threshold=200.0, warm=10)
    return p.select("event_id", F.round("evidence", 4).alias("evidence"), "drift")


PANEL = "p as (select user_id % 10 as train, user_id as car, epoch_us(ts) // 86400000000 as day, round(avg(value), 4) as indoor, round(avg(value) filter (where event_type = 'view'), 4) as outdoor, count(*) as n from events group by 1, 2, 3)"


def panel(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    day = F.floor(F.col("t") / 86_400_000_000).alias("day")
    return t.groupBy(F.col("train_id").alias("train"), F.col("component_id").alias("car"), day).agg(F.round(F.avg("value"), 4).alias("indoor"), F.round(F.avg(F.when(F.col("signal") == "view", F.col("value"))), 4).alias("outdoor"), F.count(F.lit(1)).alias("n"))


@query(f"""with {PANEL}, s as (select *, case when count(indoor) over w >= 2 then stddev_samp(indoor) over w end as sd from p window w as (partition by train, car order by day rows between 2 preceding and 2 following)), d as (select train, day, quantile_cont(outdoor, 0.5) as d from p group by 1, 2),
c as (select train, quantile_cont(d, 0.5) as cut from d group by 1), m as (select train, quantile_cont(sd, 0.5) as calm from s group by 1)
select train, car, s.day, n > 1 and indoor is not null as usable, coalesce(sd <= calm, false) as steady, coalesce(d >= cut, false) as hot from s join d using (train, day) join c using (train) join m using (train)""")
def case_masks(spark, sf_dir):
    m = saloon.case_masks(panel(spark, sf_dir), "train", "car", "day", "indoor", "outdoor", F.col("n") > 1, F.lit(True), 5)
    return m.select("train", "car", "day", "usable", "steady", "hot")


@query(f"with {PANEL}, r as (select *, (lead(indoor, 2) over (partition by train, car order by day) - indoor) / 48 as r from p), b as (select train, car, -avg(r) filter (where indoor > 40) as b from r group by 1, 2), m as (select train, quantile_cont(b, 0.5) as m from b group by 1) select train, car, round(b - m, 6) as penalty from b join m using (train)")
def pulldown_penalty(spark, sf_dir):
    return saloon.pulldown_penalty(panel(spark, sf_dir), "train", "car", "day", "indoor", F.col("indoor") > 40, 2, 48.0).select("train", "car", r6("penalty"))


@query(f"""with {TEL}, x as (select component_id as c, value as v, lag(value) over (partition by component_id order by t, event_id) as p from tel), s as (select c, max(v) - min(v) as p2p, max(v) - quantile_cont(v, 0.5) as max_dev, quantile_cont(v, 0.5) - min(v) as min_dev, quantile_cont(v, 0.5) as m, coalesce(stddev_samp(v), 0) as std, avg(v) as mu,
coalesce(avg(abs(v - p)), 0) as roughness, coalesce(stddev_samp(v - p), 0) as diff_std, quantile_cont(v, 0.99) - quantile_cont(v, 0.01) as p99, quantile_cont(v, 0.995) - quantile_cont(v, 0.005) as p995 from x group by 1), z as (select c, avg(pow(v - mu, 2)) as m2, avg(pow(v - mu, 3)) as m3, avg(pow(v - mu, 4)) as m4,
{', '.join(f'greatest(count(*) filter (where p < m + {k} * std and v >= m + {k} * std), 1) as up_{k}' for k in (1, 2, 3))} from x join s using (c) group by 1)
select c as component_id, round(p2p, 4) as p2p, round(max_dev, 4) as max_dev, round(min_dev, 4) as min_dev, round(std, 4) as std, round(coalesce(m3 / nullif(pow(m2, 1.5), 0), 0), 4) as skew, round(coalesce(m4 / nullif(m2 * m2, 0), 0), 4) as kurtosis, round(roughness + 1e-7, 4) as roughness, round(diff_std, 4) as diff_std, round(p99 + 1e-7, 4) as p99_p01, round(p995 + 1e-7, 4) as p995_p005, up_1, up_2, up_3 from s join z using (c)""")
def stress_stats(spark, sf_dir):
    s = features.stress_stats(telemetry(spark, sf_dir), ["component_id"], ["t", "event_id"], "value")
    return s.select("component_id", *[F.round(F.col(c) + (1e-7 if c in ("roughness", "p99_p01", "p995_p005") else 0), 4).alias(c) for c in ("p2p", "max_dev", "min_dev", "std", "skew", "kurtosis", "roughness", "diff_std", "p99_p01", "p995_p005")], "up_1", "up_2", "up_3")


SIDES = "s as (select l_orderkey, l_linenumber, l_quantity as v, case when l_linestatus = 'F' then 'I' else 'II' end as side from lineitem), g as (select l_orderkey, " + ", ".join(f"quantile_cont(v, 0.5) filter (where side = '{s}') as {s}_median, quantile_cont(v, 0.9) filter (where side = '{s}') as {s}_p90, max(v) filter (where side = '{s}') as {s}_max" for s in ("I", "II")) + " from s group by 1)"


def sides(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("v"), F.when(F.col("l_linestatus") == "F", "I").otherwise("II").alias("side"))


@query(f"with {SIDES} select l_orderkey, I_median, round(I_p90, 6) as I_p90, I_max, II_median, round(II_p90, 6) as II_p90, II_max, I_median - II_median as contrast from g")
def side_contrast(spark, sf_dir):
    return features.side_contrast(sides(spark, sf_dir), ["l_orderkey"], "side", "v").withColumns({c: F.round(c, 6) for c in ("I_p90", "II_p90")})


@query(f"with {SIDES}, r as (select s.l_orderkey, l_linenumber, side, row_number() over (partition by s.l_orderkey order by v desc, l_linenumber) as rank from s join g using (l_orderkey) where side = case when I_median - II_median < 0 then 'II' else 'I' end) select * from r where rank <= 3")
def implicated_side(spark, sf_dir):
    return features.implicated_side(sides(spark, sf_dir), ["l_orderkey"], "side", "l_linenumber", "v").select("l_orderkey", "l_linenumber", "side", "rank")


@query("""with g as (select l_orderkey, count(*) as n, max(l_linenumber) as declared, epoch_us(max(l_shipdate)) - epoch_us(min(l_shipdate)) as spread, list_filter([case when count(*) > 1 and min(l_discount) = max(l_discount) and count(l_discount) = count(*) then 'l_discount' end, case when count(*) > 1 and min(l_tax) = max(l_tax) and count(l_tax) = count(*) then 'l_tax' end], lambda x: x is not null) as flat from lineitem group by 1)
select l_orderkey, 'size' as problem from g where n <> declared union all select l_orderkey, 'start' from g where spread > 172800000000 union all select l_orderkey, 'constant:' || array_to_string(flat, ',') from g where len(flat) > 0""")
def peer_group_guards(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").withColumn("t", F.unix_micros(F.col("l_shipdate").cast("timestamp")))
    return peers.peer_group_guards(li, ["l_orderkey"], "l_linenumber", "t", ["l_discount", "l_tax"], 172_800_000_000)


@query("""with n as materialized (select l_orderkey, l_linenumber, l_suppkey, l_linestatus, l_quantity as v, row_number() over () as i from lineitem), d as (select a.i, any_value(a.l_orderkey) as l_orderkey, any_value(a.l_linenumber) as l_linenumber, any_value(a.l_suppkey) as s, any_value(a.v) as v, avg(b.v) as m from n a left join n b on a.l_orderkey = b.l_orderkey and a.i <> b.i group by 1),
td as (select a.i, any_value(a.l_suppkey) as s, coalesce(any_value(a.v) - avg(b.v), 0) as d from n a left join n b on a.l_orderkey = b.l_orderkey and a.i <> b.i and b.l_linestatus = 'F' where a.l_linestatus = 'F' group by 1), c as (select s, quantile_cont(d, 0.5) as c, stddev_pop(d) as sd from td group by 1), b as (select s, any_value(c) as c, any_value(sd) as sd, 1.4826 * quantile_cont(abs(d - c), 0.5) as mad from td join c using (s) group by 1)
select l_orderkey, l_linenumber, round(abs(coalesce(v - m, 0) - c) / case when mad > 0 then mad when sd > 0 then sd else 1 end, 5) as score from d left join b using (s)""")
def det_peer_value(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_linestatus", "l_quantity")
    x = peers.peer_value_scores(li, li.where("l_linestatus = 'F'"), ["l_suppkey"], ["l_orderkey"], "l_quantity")
    return x.select("l_orderkey", "l_linenumber", F.round("score", 5).alias("score"))


@query("""with r as (select p_brand, p_type, p_size % 2 as split, avg(p_retailprice) as f1 from part group by all), c as (select * from r where split = 0), h as (select * from r where split = 1)
select h.p_brand, h.p_type, round(c.f1 - h.f1, 6) as generalisation_gap from h left join c on c.p_brand is not distinct from h.p_brand and c.p_type is not distinct from h.p_type""")
def generalisation_gap(spark, sf_dir):
    r = read(spark, sf_dir, "part").groupBy("p_brand", "p_type", (F.col("p_size") % 2).alias("split")).agg(F.avg("p_retailprice").alias("f1"))
    return report.generalisation_gap(r, ["p_brand", "p_type"], "split", "f1", 0, 1).select("p_brand", "p_type", r6("generalisation_gap"))


FLAGS = {"u": "o_totalprice < 50000", "s": "o_orderstatus = 'P'", "i": "o_custkey % 7 = 0", "f": "o_orderkey % 5 = 0"}


@query("with r as (select o_orderkey, " + ", ".join(f"{v} as {k}" for k, v in FLAGS.items()) + """ from orders) select o_orderkey, not (u or i or (s and not f)) as eligible,
case when u then 'uncalibrated' when i then 'episodes impossible' when f then case when s then 'budget n/a, silent on validation' else 'budget n/a' end when s then 'silent' else 'calibrated' end as op_point from r""")
def operating_point(spark, sf_dir):
    r = read(spark, sf_dir, "orders").select("o_orderkey", *[F.expr(v).alias(k) for k, v in FLAGS.items()])
    return report.operating_point(r, "u", "s", "i", "f").select("o_orderkey", "eligible", "op_point")


@query("""select o_custkey, count(*) as folds, sum(o_orderkey % 10)::bigint as events, sum(o_orderkey % 4)::bigint as found, bool_or(o_totalprice > 400000) as flag, array_to_string(list_sort(list(distinct o_orderpriority)), ';') as o_orderpriority, round(avg(o_totalprice) + 1e-7, 4) as metric,
round(sum(o_orderkey % 4) / nullif(sum(o_orderkey % 10), 0)::double, 6) as recall from orders group by 1""")
def fold_aggregate(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 10).alias("events"), (F.col("o_orderkey") % 4).alias("found"), (F.col("o_totalprice") > 400000).alias("flag"), "o_orderpriority", F.col("o_totalprice").alias("metric"))
    g = report.fold_aggregate(o, ["o_custkey"], ["events", "found"], ["flag"], ["o_orderpriority"], ["metric"], {"recall": ("found", "events")})
    return g.withColumns({"metric": F.round(F.col("metric") + 1e-7, 4), "recall": F.round("recall", 6)})


@query("with g as (select o_custkey, (row_number() over (order by count(*) desc, o_custkey) - 1) % 10 as r from orders group by 1) select o_orderkey, (case when r < 5 then r else 9 - r end)::int as fold from orders join g using (o_custkey)")
def group_kfold(spark, sf_dir):
    return splits.group_kfold(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 5).select("o_orderkey", "fold")


@query("""with x as (select repeat, s_suppkey, s_acctbal as y, (row_number() over (partition by repeat order by md5(repeat || '-' || s_suppkey), s_suppkey) - 1) % 4 as fold from supplier, (select unnest(range(0, 3)) as repeat)),
f as (select repeat, fold, sum(y) as s, count(*) as n from x group by 1, 2), t as (select repeat, sum(s) as ts, sum(n) as tn from f group by 1), e as (select repeat, avg(abs(y - (ts - s) / (tn - n))) as e from x join f using (repeat, fold) join t using (repeat) group by 1) select round(avg(e), 4) as error, round(stddev_samp(e), 4) as deviation from e""")
def repeated_kfold(spark, sf_dir):
    """The error of the other folds' mean, over three deals into four folds."""
    x = splits.repeated_kfold(read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("y")), "s_suppkey", 4, 3)
    f = x.groupBy("repeat", "fold").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    t = f.groupBy("repeat").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    guess = (F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))
    return splits.repeat_errors(x.join(f, ["repeat", "fold"]).join(t, "repeat").withColumn("guess", guess), "y", "guess").select(F.round("error", 4).alias("error"), F.round("deviation", 4).alias("deviation"))


@query(f"""with {TEL}, p as (select component_id, value, row_number() over (partition by component_id order by t, event_id) - 1 as p, count(*) over (partition by component_id) as n from tel)
select component_id, i::int as slice, count(*) as n, round(avg(value), 6) as mean from p, (select unnest(range(0, 3)) as i) where p >= i * (n // 4) and p < i * (n // 4) + n // 2 group by 1, 2""")
def subwindow_slices(spark, sf_dir):
    w = Window.partitionBy("component_id")
    t = telemetry(spark, sf_dir).select("component_id", "value", (F.row_number().over(w.orderBy("t", "event_id")) - 1).alias("p"), F.count(F.lit(1)).over(w).alias("len"))
    return splits.subwindow_slices(t, ["component_id"], "p", "len").groupBy("component_id", "slice").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "mean"))


REACHES, GAP = (7_200_000_000, 86_400_000_000, 864_000_000_000), 43_200_000_000


@query(f"""with {TEL}, x as (select component_id, t, abs(t - {AT}) as far from tel where abs(t - {AT}) <= {REACHES[-1]}), m as (select component_id, case {' '.join(f'when min(far) <= {r} then {r}' for r in REACHES)} end as reach from x group by 1),
g as (select component_id, t, reach, case when t - lag(t) over (partition by component_id order by t) <= {GAP} then 0 else 1 end as new from x join m using (component_id) where far <= reach), s as (select *, sum(new) over (partition by component_id order by t) as s from g),
c as (select component_id, s, min(t) as t_start, max(t) as t_end, count(*) as n, any_value(reach) as reach from s group by 1, 2), r as (select *, row_number() over (partition by component_id order by t_start - ({AT} - reach) < {GAP} or {AT} + reach - t_end < {GAP}, abs((t_start + t_end) // 2 - {AT}), t_start) as r from c) select component_id, t_start, t_end, n from r where r = 1""")
def nearest_cycle(spark, sf_dir):
    return serve.nearest_cycle(telemetry(spark, sf_dir), ["component_id"], "t", AT, GAP, REACHES)


COLS = ["o_totalprice", "o_custkey"]


@query("with s as (select " + ", ".join(f"skewness({c}) as {c}_s" for c in COLS) + " from orders), t as (select o_orderkey, " + ", ".join(f"-ln(count(*) over (order by {c}) / count(*) over ()::double) as {c}_l, -ln(count(*) over (order by {c} desc) / count(*) over ()::double) as {c}_r" for c in COLS)
       + " from orders) select o_orderkey, round(" + " + ".join(f"greatest(case when {c}_s < 0 then {c}_l else {c}_r end, ({c}_l + {c}_r) / 2)" for c in COLS) + ", 5) as score from t, s")
def det_copod(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", *[F.col(c).cast("double").alias(c) for c in COLS])
    return detect.copod(o, ["o_orderkey"], COLS).select("o_orderkey", F.round("score", 5).alias("score"))


@query(PH)
def stream_page_hinkley(spark, sf_dir):
    p = drained(spark, streams.stream_page_hinkley(events(spark, sf_dir), threshold=200.0, warm=10), "append")
    return p.select("event_id", F.round("evidence", 4).alias("evidence"), "drift")


NEAR = 21_600_000_000


@query(f"""with recursive {TEL}, o as (select train_id, component_id as s, event_id, t, row_number() over (partition by train_id order by t, event_id) as i from tel), g as (select train_id, event_id, i, t as a, [s] as seen, 1::bigint as g from o where i = 1 union all
select train_id, event_id, i, case when new then t else a end, case when new then [s] else list_append(seen, s) end, case when new then g + 1 else g end from (select o.train_id, o.event_id, o.i, o.t, o.s, a, seen, g, o.t - a > {NEAR} or list_contains(seen, o.s) as new from g join o on o.train_id = g.train_id and o.i = g.i + 1)) select event_id, g as peer_group from g""")
def peer_groups(spark, sf_dir):
    return peers.peer_groups(telemetry(spark, sf_dir), "train_id", "component_id", "t", "event_id", NEAR).select("event_id", "peer_group")


@query(f"""with {EP}, i as (select ep.component_id, episode, t, event_id, score, row_number() over (partition by ep.component_id, episode order by t desc, event_id desc) as r from ep join sc on sc.component_id = ep.component_id and sc.t between t_start and t_end)
select ep.component_id, ep.episode::bigint as episode, round(any_value(t_end - t_start) / 3.6e9, 6) as hours, max(i.score) filter (where r = 1) as score, max(i.score) as peak, string_agg(event_id::varchar, ',' order by r) filter (where r <= 12) as events from ep join i on i.component_id = ep.component_id and i.episode = ep.episode group by 1, 2""")
def alert_context(spark, sf_dir):
    c = serve.alert_context(found(spark, sf_dir), scores(spark, sf_dir).select("component_id", "t", "event_id", "score"), ["component_id"], "episode")
    return c.select("component_id", "episode", r6("hours"), "score", "peak", F.array_join(F.col("events").cast("array<string>"), ",").alias("events"))


@query("""with r as (select s_nationkey, s_suppkey, s_suppkey % 3 = 0 as measured, coalesce(case when s_acctbal > 0 then s_acctbal end, case when s_suppkey % 2 = 0 then abs(s_acctbal) end) as v from supplier), c as (select s_nationkey, min(s_suppkey) as c from r group by 1),
n as (select r.*, case when s_suppkey = c then 'control' else 'm' || s_suppkey end as name from r join c using (s_nationkey)), b as (select *, row_number() over (partition by s_nationkey order by measured desc, v desc nulls last, name) as r from n where name <> 'control')
select b.s_nationkey, b.name, b.v as validated, b.v is null as deferred, n.v as floor from b left join n on n.s_nationkey = b.s_nationkey and n.name = 'control' where r = 1""")
def select_per_subsystem(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").withColumn("c", F.min("s_suppkey").over(Window.partitionBy("s_nationkey")))
    s = s.select("s_nationkey", F.when(F.col("s_suppkey") == F.col("c"), "control").otherwise(F.concat(F.lit("m"), F.col("s_suppkey").cast("string"))).alias("name"), (F.col("s_suppkey") % 3 == 0).alias("measured"),
                 F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("auprc"), F.when(F.col("s_suppkey") % 2 == 0, F.abs("s_acctbal")).alias("f1"))
    return report.select_per_subsystem(s, "s_nationkey", "name", "measured", ["auprc", "f1"], "control")


@query("select count(*) filter (where c_nationkey % 5 = 1) as allowed, count(*) filter (where c_nationkey % 5 <> 1) as barred, (sum(('0x' || substr(md5(c_custkey::varchar), 1, 8))::bigint) filter (where c_nationkey % 5 = 1))::bigint as digest from customer")
def validation_guard(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("part", F.when(F.col("c_nationkey") % 5 == 1, "val").otherwise("train"))
    return report.validation_guard(c, "part", "c_custkey")


DUTY = (2 * DAY_US, 8 * DAY_US, DAY_US // 4)


@query(f"""with {TEL}, b as (select component_id, min(t) as t0 from tel group by 1), f as (select component_id, quantile_cont(value, 0.4) as floor from tel join b using (component_id) where t < t0 + {DUTY[1]} group by 1),
r as (select component_id, event_id, t, quantile_cont(value, 0.5) over (partition by component_id order by t range between {DUTY[0] - 1} preceding and current row) as m from tel), x as (select *, round(m, 9) < round(floor, 9) as o, floor - m as e from r join f using (component_id)),
i as (select *, row_number() over w - sum(o::int) over (w rows unbounded preceding) as isle from x window w as (partition by component_id order by t, event_id)), c as (select *, sum(e - 0.5) over w as p, t - min(t) over w as held from i where o window w as (partition by component_id, isle order by t, event_id rows unbounded preceding))
select event_id, round(case when held >= {DUTY[2]} then p - least(0, min(p) over (partition by component_id, isle order by t, event_id rows unbounded preceding)) else 0 end, 5) as score from c""")
def det_duty_ratio(spark, sf_dir):
    return detect.duty_ratio(telemetry(spark, sf_dir), ["component_id"], ["t", "event_id"], "t", "value", *DUTY, low=0.4).select("event_id", F.round("score", 5).alias("score"))


@query(f"""with {TEL}, a as (select *, value > 100 as on_, lag(value > 100) over (partition by component_id order by t, event_id) as was from tel), ev as (select component_id, t as at from a where on_ <> was), z as (select event_id, component_id, t, (value - 50) / 50 as z from tel),
p as (select *, sum(z - 0.5) over w as u, sum(-z - 0.5) over w as d from z window w as (partition by component_id order by t, event_id rows unbounded preceding)), c as (select *, greatest(u - least(0, min(u) over w), d - least(0, min(d) over w)) as cusum from p window w as (partition by component_id order by t, event_id rows unbounded preceding))
select event_id, round(case when exists (select 1 from ev where ev.component_id = c.component_id and abs(ev.at - c.t) <= {DAY_US}) then cusum else abs(z) end, 5) as score from c""")
def det_transition_mask(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    edges = segments.edge_events(t, ["component_id"], "t", F.col("value") > 100, "event_id").select("component_id", F.col("t").alias("at"))
    x = detect.transition_mask(t.select("event_id", "component_id", "t", "value"), edges, ["component_id"], ["t", "event_id"], "t", (F.col("value") - 50) / 50, DAY_US)
    return x.select("event_id", F.round("score", 5).alias("score"))


IOU = f"""{EP}, {FLT}, cand as (select ep.component_id, fault_id as true_id, episode::bigint as found_id, (least(t_end, failure) - greatest(t_start, onset)) / (greatest(t_end, failure) - least(t_start, onset))::double as iou from ep join flt on flt.component_id = ep.component_id and least(t_end, failure) > greatest(t_start, onset)),
rk as (select *, row_number() over (partition by component_id order by iou desc, true_id, found_id) as i from cand), go as (select component_id, i, true_id, found_id, iou, true as hit, [true_id] as ut, [found_id] as uf from rk where i = 1 union all
select component_id, i, true_id, found_id, iou, hit, case when hit then list_append(ut, true_id) else ut end, case when hit then list_append(uf, found_id) else uf end from (select rk.*, ut, uf, not list_contains(ut, rk.true_id) and not list_contains(uf, rk.found_id) as hit from go join rk on rk.component_id = go.component_id and rk.i = go.i + 1)),
mt as (select component_id, true_id, found_id, iou from go where hit)"""


def judged_intervals(spark, sf_dir):
    truth = fault_log(spark, sf_dir).select("component_id", F.col("fault_id").alias("id"), F.col("onset").alias("a"), F.col("failure").alias("b"))
    got = found(spark, sf_dir).select("component_id", F.col("episode").alias("id"), F.col("t_start").alias("a"), F.col("t_end").alias("b")).checkpoint()
    return truth, got, intervals.iou_match(intervals.overlaps(truth, got, ["component_id"], 2 * DAY_US), ["component_id"])


@query(f"with recursive {IOU} select component_id, true_id, found_id, round(iou, 6) as iou from mt")
def iou_match(spark, sf_dir):
    return judged_intervals(spark, sf_dir)[2].select("component_id", "true_id", "found_id", r6("iou"))


@query(f"with recursive {IOU}, q as (select coalesce((select sum(iou) from mt), 0) as s, (select count(*) from flt) as n, (select count(*) from ep) as m), rp as (select coalesce(s / nullif(n, 0), 0) as r, coalesce(s / nullif(m, 0), 0) as p from q) select round(r, 6) as soft_recall, round(p, 6) as soft_precision, round(coalesce(2 * r * p / nullif(r + p, 0), 0), 6) as score from rp")
def iou_f1(spark, sf_dir):
    return intervals.iou_f1(*judged_intervals(spark, sf_dir)).select(r6("soft_recall"), r6("soft_precision"), r6("score"))


@query("""with tr as (select * from lineitem where l_returnflag <> 'R'), x as (select l_suppkey::varchar as op, l_quantity as v from tr where l_suppkey % 9 <> 0 union all select '*', l_quantity from tr where l_suppkey % 9 <> 0), c as (select op, quantile_cont(v, 0.5) as c from x group by 1), s as (select op, c, 1.4826 * quantile_cont(abs(v - c), 0.5) as m from x join c using (op) group by 1, 2),
k as (select op, c, case when m > 0 then m when c <> 0 then abs(c) * 0.05 else 1 end as s from s), y as (select l_orderkey, l_linenumber, l_quantity as v, coalesce(k.c, a.c) as c, coalesce(k.s, a.s) as s from lineitem left join k on k.op = l_suppkey::varchar, (select * from k where op = '*') a) select l_orderkey, l_linenumber, round(v / nullif(c, 0) + 1e-8, 6) as rel, round((v - c) / s, 6) as z from y""")
def fold_baseline(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag")
    x = features.fold_baseline(li, li.where("l_returnflag <> 'R' and l_suppkey % 9 <> 0"), "l_suppkey", "l_quantity")
    return x.select("l_orderkey", "l_linenumber", r6(F.col("rel") + 1e-8, "rel"), r6("z"))
