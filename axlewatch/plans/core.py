"""Queries of schema checks, scalar functions, reshaping, joins, segments and features over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from axlewatch.functions import scalar
from axlewatch.operators import features, joins, reshape, segments, validate
from axlewatch.operators.ranked import dealt
from axlewatch.plans.registry import query, r6
from axlewatch.sources.bind import DAY_US, FLT, TEL, fault_log, read, telemetry

GAP3 = 3 * DAY_US
SEG = f"""{TEL}, stepped as (select *, t - lag(t) over (partition by component_id order by t, event_id) as step from tel),
seg as (select *, sum(case when step > {GAP3} then 1 else 0 end) over (partition by component_id order by t, event_id rows unbounded preceding) as segment from stepped)"""
WIN = f"""{SEG}, placed as (select *, row_number() over (partition by component_id, segment order by t, event_id) - 1 as p, count(*) over (partition by component_id, segment) as n from seg),
win as (select component_id, train_id, segment, t, value, event_id, w as "window", p - w * 3 as pos from placed, unnest(generate_series(0, (n - 6) // 3)) u(w) where n >= 6 and p between w * 3 and w * 3 + 5)"""


def segmented(spark, sf_dir):
    return segments.gap_segments(dealt(telemetry(spark, sf_dir), ["component_id"]), ["component_id"], "t", GAP3, "event_id")


def windowed(spark, sf_dir):
    return segments.make_windows(segmented(spark, sf_dir), ["component_id", "segment"], "t", 6, 3, "event_id")


# schema and checks


@query(f"with {TEL} select event_id, cast(component_id as varchar) as component_id, cast(train_id as tinyint) as car, signal, round(cast(cast(value as float) as double), 4) as value, t from tel")
def coerce_table(spark, sf_dir):
    out = validate.coerce_table(telemetry(spark, sf_dir).withColumnRenamed("train_id", "car"), {"event_id": "bigint", "component_id": "string", "car": "tinyint", "signal": "string", "value": "float", "t": "bigint"})
    return out.withColumn("value", F.round(F.col("value").cast("double"), 4))


@query(f"""with {TEL} select 'unknown_signal' as rule, count(*) as n from tel where signal not in ('click', 'error', 'view') union all
select 'value_range', count(*) from tel where not (value between 0 and 150) union all select 'null_key', count(*) from tel where component_id is null or t is null""")
def validate_long(spark, sf_dir):
    rules = {"unknown_signal": ~F.col("signal").isin("click", "error", "view"), "value_range": ~F.col("value").between(0, 150), "null_key": F.col("component_id").isNull() | F.col("t").isNull()}
    return validate.violations(telemetry(spark, sf_dir), rules)


@query("select 'total_negative' as rule, count(*) as n from orders where o_totalprice < 0 union all select 'status_vocabulary', count(*) from orders where o_orderstatus not in ('F', 'O') union all select 'price_high', count(*) from orders where o_totalprice > 300000")
def validate_features(spark, sf_dir):
    return validate.violations(read(spark, sf_dir, "orders"), {"total_negative": F.col("o_totalprice") < 0, "status_vocabulary": ~F.col("o_orderstatus").isin("F", "O"), "price_high": F.col("o_totalprice") > 300000})


@query(f"with {TEL}, {FLT} select 'onset_after_failure' as rule, count(*) as n from flt where onset > failure union all select 'no_component', count(*) from flt where component_id is null")
def validate_fault_log(spark, sf_dir):
    return validate.violations(fault_log(spark, sf_dir), {"onset_after_failure": F.col("onset") > F.col("failure"), "no_component": F.col("component_id").isNull()})


@query(f"with {TEL} select 'bad_json' as rule, count(*) as n from tel where not json_valid(props) union all select 'no_key', count(*) from tel where json_extract_string(props, '$.k') is null")
def validate_events(spark, sf_dir):
    return validate.violations(telemetry(spark, sf_dir), {"bad_json": F.try_parse_json("props").isNull(), "no_key": F.get_json_object("props", "$.k").isNull()})


@query(f"with {TEL} select event_id, component_id, t, value from tel where t >= epoch_us(timestamp '2024-01-05') and t < epoch_us(timestamp '2024-01-12')")
def slice_time_range(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("ts >= timestamp_ntz '2024-01-05' and ts < timestamp_ntz '2024-01-12'")
    return e.select("event_id", F.col("user_id").alias("component_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")


@query(f"with {TEL} select t, signal, value from tel where component_id = 7 and signal = 'error'")
def read_series_scan(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("user_id = 7 and event_type = 'error'")
    return e.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_type").alias("signal"), "value")


@query(f"with {TEL} select signal, count(*) as n, count(value) as n_values, round(avg(case when value is null then 1.0 else 0.0 end), 6) as null_share, min(t) as t_min, max(t) as t_max from tel group by signal")
def dataset_summary(spark, sf_dir):
    return validate.dataset_summary(telemetry(spark, sf_dir), ["signal"], "t", "value")


@query("with runs as (select o_orderkey as run, o_custkey as train from orders), picked as (select train from runs where run % 97 = 0) select run, train from runs where train in (select train from picked)")
def complete_units(spark, sf_dir):
    runs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("train"))
    return validate.complete_units(runs, runs.where("run % 97 = 0"), "train")


@query("""with a as (select o_orderkey as id, o_orderstatus as label from orders), b as (select l_orderkey as id, min(l_linestatus) as label from lineitem where l_orderkey % 50 <> 0 group by 1)
select 'missing' as error, count(*) as n from a where id not in (select id from b) union all select 'unknown', count(*) from b where id not in (select id from a)
union all select 'duplicate', count(*) from (select id from b group by id having count(*) > 1) union all select 'label', count(*) from b where label not in ('F')""")
def prediction_table_check(spark, sf_dir):
    truth = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    given = read(spark, sf_dir, "lineitem").where("l_orderkey % 50 <> 0").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_linestatus").alias("label"))
    return validate.prediction_table_check(given, truth, ["F"])


@query("select l_orderkey, l_linenumber, l_quantity from lineitem")
def column_dropout(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return validate.column_dropout(li, [c for c in li.columns if c not in ("l_orderkey", "l_linenumber", "l_quantity")], set(li.columns) - {"l_orderkey", "l_linenumber"})


# scalar functions


@query("select event_id, case when value < 20 then 0 when value < 50 then 1 else 2 end as state from events")
def compressor_state(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", scalar.compressor_state(F.col("value"), 20.0, 50.0).alias("state"))


@query("select event_id, 'run' || (user_id % 10) || '/' || user_id as series_id, 'rec_' || substr(sha256('run' || (user_id % 10) || '/' || user_id), 1, 12) as opaque from events")
def series_id(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    sid = scalar.series_id(F.concat(F.lit("run"), F.col("user_id") % 10), F.col("user_id"))
    return e.select("event_id", sid.alias("series_id"), scalar.opaque_series_id(sid).alias("opaque"))


@query("with c as (select c_custkey, 'box_' || case when c_custkey % 2 = 0 then 'L' else 'R' end || (c_custkey % 4 + 1) as name from customer) select c_custkey, regexp_extract(name, '_([LR])', 1) as side, cast(regexp_extract(name, '([0-9]+)$', 1) as integer) as position, case when c_custkey % 4 + 1 in (1, 3) then c_custkey % 4 + 2 else c_custkey % 4 end as partner from c")
def component_side(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("box_"), F.when(F.col("c_custkey") % 2 == 0, "L").otherwise("R"), F.col("c_custkey") % 4 + 1).alias("name"))
    return c.select("c_custkey", scalar.component_side(F.col("name")).alias("side"), scalar.component_index(F.col("name")).alias("position"), scalar.bogie_partner(scalar.component_index(F.col("name"))).cast("bigint").alias("partner"))


@query("select p_partkey, round(least(1.0, 0.2 + 0.2 * (p_size % 6 - 1)), 6) as severity from part")
def severity_from_level(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.round(scalar.severity_from_level(F.col("p_size") % 6), 6).alias("severity"))


@query("select event_id, year(ts) || '-' || month(ts) || '-' || day(ts) || '-' || hour(ts) || '-' || minute(ts) || '-' || second(ts) || '-' || (millisecond(ts) % 1000) as native, epoch_us(ts) // 1000 as ms from events")
def parse_native_ts(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", scalar.format_native_ts(F.col("ts").cast("timestamp")).alias("native"))
    return e.select("event_id", "native", F.unix_millis(scalar.parse_native_ts(F.col("native"))).alias("ms"))


@query("select s_suppkey, s_name, cast(nullif(regexp_extract(s_name, '([0-9]+)', 1), '') as bigint) as number from supplier")
def natural_sort_key(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", scalar.natural_number(F.col("s_name")).alias("number"))


@query("""with g as (select p_partkey, 6.0 + p_size % 10 as n, 0.1 + (p_size % 7) / 20.0 as r from part) select p_partkey, round(n / 2 * (1 - r), 6) as bpfo, round(n / 2 * (1 + r), 6) as bpfi, round((1 - r * r) / (2 * r), 6) as bsf, round((1 - r) / 2, 6) as ftf from g""")
def bearing_factors(spark, sf_dir):
    g = read(spark, sf_dir, "part").select("p_partkey", (F.lit(6.0) + F.col("p_size") % 10).alias("n"), (F.lit(0.1) + (F.col("p_size") % 7) / 20.0).alias("r"))
    return g.select("p_partkey", *[F.round(c, 6).alias(k) for k, c in scalar.bearing_factors(F.col("n"), F.col("r")).items()])


@query("select l_orderkey, l_linenumber, round(l_extendedprice / 60.0, 6) as hz_rpm, round(l_quantity / (pi() * 0.84), 6) as hz_speed from lineitem")
def shaft_speed(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", r6(scalar.hz_from_rpm(F.col("l_extendedprice")), "hz_rpm"), r6(scalar.hz_from_speed(F.col("l_quantity"), 0.84), "hz_speed"))


@query("select event_id, round(10 * log10(greatest(value, 1e-12)), 6) as power_db, round(20 * log10(greatest(value, 1e-6)), 6) as amplitude_db from events")
def db_scale(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", r6(scalar.power_db(F.col("value")), "power_db"), r6(scalar.amplitude_db(F.col("value")), "amplitude_db"))


@query("select event_id, round(sin(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24), 6) + 0.0 as hour_sin, round(cos(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24), 6) + 0.0 as hour_cos from events")
def hour_cyclic(spark, sf_dir):
    s, c = scalar.hour_cyclic(F.col("ts"))
    return read(spark, sf_dir, "events").select("event_id", (F.round(s, 6) + 0.0).alias("hour_sin"), (F.round(c, 6) + 0.0).alias("hour_cos"))  # no negative zero


@query("select event_id, round(least(greatest(coalesce(value / 10, 1.0), 0), 10), 6) as ratio, round(least(greatest(coalesce((value - 100) / 3, 0.0), -25), 25), 6) as z from events")
def robust_clip(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", r6(scalar.clip_ratio(F.col("value") / 10), "ratio"), r6(scalar.clip_z((F.col("value") - 100) / 3), "z"))


@query("select l_orderkey, l_linenumber, round(ln(greatest(l_extendedprice, 1e-12)), 6) as log_price, round(ln(greatest(l_discount, 1e-12)), 6) as log_discount, l_tax from lineitem")
def to_log_features(spark, sf_dir):
    li = scalar.to_log_features(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), "l_tax"), ["price", "discount"])
    return li.select("l_orderkey", "l_linenumber", r6("log_price"), r6("log_discount"), "l_tax")


@query("select vec_id, round(cast(embedding[1] as double), 5) as x_0, round(cast(embedding[2] as double), 5) as x_1, round(cast(embedding[3] as double), 5) as x_2 from embeddings")
def expand_vector_columns(spark, sf_dir):
    return reshape.expand_vector(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", "x", 3).select("vec_id", *[F.round(F.col(f"x_{i}").cast("double"), 5).alias(f"x_{i}") for i in range(3)])


@query("select user_id, round(coalesce(avg(value) filter (where value between 50 and 150), quantile_cont(value, 0.5)), 6) as level from events group by user_id")
def plausible_mean(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(r6(scalar.plausible_mean("value", 50, 150), "level"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_payload_extract(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# reshape


@query(f"with {TEL} select component_id, t // 86400000000 as day, avg(value) filter (where signal = 'click') as click, avg(value) filter (where signal = 'error') as error, avg(value) filter (where signal = 'absent') as absent from tel group by 1, 2")
def to_wide(spark, sf_dir):
    t = telemetry(spark, sf_dir).groupBy("component_id", F.floor(F.col("t") / DAY_US).alias("day"), "signal").agg(F.avg("value").alias("value"))
    return reshape.to_wide(t, ["component_id", "day"], "signal", "value", ["click", "error", "absent"])


@query("select l_orderkey, l_linenumber, signal, value from (select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax from lineitem) unpivot (value for signal in (l_quantity, l_discount, l_tax))")
def to_long(spark, sf_dir):
    return reshape.to_long(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query(f"with {WIN} select component_id, segment, \"window\", array_to_string(list(round(value, 3) order by pos), ',') as samples from win group by 1, 2, 3")
def window_matrix(spark, sf_dir):
    m = reshape.window_matrix(windowed(spark, sf_dir), ["component_id", "segment", "window"], "pos", "value")
    return m.select("component_id", "segment", "window", F.array_join(F.transform("samples", lambda x: F.round(x, 3).cast("string")), ",").alias("samples"))


@query("select c_custkey as id, c_acctbal as balance, c_mktsegment as segment, null as name from customer union all select s_suppkey, s_acctbal, null, s_name from supplier")
def concat_features(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return reshape.concat_features([c, read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))])


# joins


@query(f"with {TEL}, r as (select component_id, t as rt, max(value) as context from tel where signal = 'view' group by 1, 2) select a.event_id, b.context from (select * from tel where signal <> 'view') a asof left join r b on a.component_id = b.component_id and a.t >= b.rt")
def asof_backward(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    right = t.where("signal = 'view'").select("component_id", F.col("t").alias("rt"), F.col("value").alias("context"))
    return joins.asof_backward(t.where("signal <> 'view'"), right, ["component_id"], "t", "rt", ["context"]).select("event_id", "context")


@query(f"""with {TEL}, {FLT}, f as (select component_id, onset, max(failure) as failure from flt group by 1, 2)
select event_id, coalesce(t <= failure, false) as is_faulty, round(case when t <= failure then pow((t - onset) / (failure - onset), 2) else 0 end, 6) as severity, round(case when t <= failure then (failure - t) / 1e6 end, 3) as rul_s, coalesce(t <= failure and failure - t <= {GAP3}, false) as alarm
from tel asof left join f on tel.component_id = f.component_id and tel.t >= f.onset""")
def label_from_fault_log(spark, sf_dir):
    return joins.label_from_fault_log(telemetry(spark, sf_dir), fault_log(spark, sf_dir)).select("event_id", "is_faulty", r6("severity"), F.round("rul_s", 3).alias("rul_s"), "alarm")


@query(f"with {TEL}, {FLT} select tel.event_id, bool_or(fault_id is not null) as is_faulty, round(min((failure - t) / 1e6), 3) as rul_s, max(fault_id) as fault_id from tel left join flt on tel.component_id = flt.component_id and t between onset and failure group by tel.event_id")
def label_from_events(spark, sf_dir):
    return joins.label_from_events(telemetry(spark, sf_dir), fault_log(spark, sf_dir)).select("event_id", "is_faulty", F.round("rul_s", 3).alias("rul_s"), "fault_id")


@query(f"with {SEG}, {FLT}, s as (select component_id, segment, min(t) as a, max(t) as b from seg group by 1, 2) select component_id, segment from s where exists (select 1 from flt where flt.component_id = s.component_id and s.a <= failure and s.b >= onset - {GAP3})")
def label_cycles_overlap(spark, sf_dir):
    s = segmented(spark, sf_dir).groupBy("component_id", "segment").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"))
    return joins.overlaps_fault(s, fault_log(spark, sf_dir), "segment", GAP3).select("component_id", "segment")


@query(f"""with {TEL}, {FLT} select event_id, least(t - (select max(onset) from flt where flt.component_id = tel.component_id and onset <= t), (select min(onset) from flt where flt.component_id = tel.component_id and onset >= t) - t) as distance from tel""")
def nearest_event_distance(spark, sf_dir):
    return joins.nearest_event_distance(telemetry(spark, sf_dir), fault_log(spark, sf_dir), ["component_id"], "t", "onset").select("event_id", "distance")


@query(f"with {TEL}, {FLT} select event_id from tel where not exists (select 1 from flt where flt.component_id = tel.component_id and t > failure and t <= failure + 86400000000)")
def blank_post_failure(spark, sf_dir):
    return joins.blank_post_failure(telemetry(spark, sf_dir), fault_log(spark, sf_dir), DAY_US).select("event_id")


@query(f"with {TEL}, patch as (select * from tel where signal = 'error' and component_id % 3 = 0), cut as (select component_id, min(t) as c from patch group by 1) select event_id, value from tel where not exists (select 1 from cut where cut.component_id = tel.component_id and tel.t >= c) union all select event_id, value + 1 from patch")
def overlay_patch(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    patch = t.where("signal = 'error' and component_id % 3 = 0").withColumn("value", F.col("value") + 1)
    return joins.overlay_patch(t, patch, ["component_id"], "t").select("event_id", "value")


# segments


@query(f"with {SEG} select event_id, segment from seg")
def gap_segments(spark, sf_dir):
    return segmented(spark, sf_dir).select("event_id", "segment")


@query(f"with {WIN} select component_id, segment, \"window\", pos, event_id from win")
def make_windows(spark, sf_dir):
    return windowed(spark, sf_dir).select("component_id", "segment", "window", "pos", "event_id")


@query(f"with {TEL} select component_id, t // 86400000000 as bin, round(avg(value), 6) as mean, max(value) as peak, count(value) as n, round(avg(case when value > 100 then 1.0 else 0.0 end), 6) as duty, bool_or(value > 100) and bool_or(value <= 100) as is_transition from tel group by 1, 2")
def fixed_bins(spark, sf_dir):
    return segments.fixed_bins(telemetry(spark, sf_dir), ["component_id"], "t", "value", DAY_US, F.col("value") > 100).select("component_id", "bin", r6("mean"), "peak", "n", r6("duty"), "is_transition")


@query(f"with {TEL}, a as (select *, case when value > 50 and lag(value) over (partition by component_id order by t, event_id) <= 50 then 1 else 0 end as e from tel), c as (select *, sum(e) over (partition by component_id order by t, event_id rows unbounded preceding) as cycle from a) select event_id, cycle from c where cycle > 0")
def duty_cycles(spark, sf_dir):
    return segments.duty_cycles(telemetry(spark, sf_dir), ["component_id"], "t", F.col("value") > 50, "event_id").select("event_id", "cycle")


@query(f"with {TEL}, a as (select *, lag(value) over (partition by component_id order by t, event_id) as p from tel) select event_id, case when value > 50 then 'rise' else 'fall' end as event from a where p is not null and (value > 50) <> (p > 50)")
def edge_events(spark, sf_dir):
    return segments.edge_events(telemetry(spark, sf_dir), ["component_id"], "t", F.col("value") > 50, "event_id").select("event_id", "event")


@query(f"with {TEL}, a as (select *, row_number() over (partition by component_id order by t, event_id) - 1 as p, count(*) over (partition by component_id) as n from tel) select event_id, (select count(*) from generate_series(1, 4) g(i) where round_even(i * n / 5.0, 0) <= p) as block from a")
def contiguous_blocks(spark, sf_dir):
    return segments.contiguous_blocks(telemetry(spark, sf_dir), ["component_id"], "t", 5, "event_id").select("event_id", "block")


# features


STATS_SQL = f"""with {WIN}, m as (select *, avg(value) over (partition by component_id, segment, "window") as mu from win)
select component_id, segment, "window", count(value) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, min(value) as min, max(value) as max, round(regr_slope(value, pos), 6) as slope, round(sqrt(avg(value * value)), 6) as rms,
round(avg(pow(value - mu, 4)) / nullif(pow(avg(pow(value - mu, 2)), 2), 0), 5) as kurtosis, round(max(abs(value)) / nullif(sqrt(avg(value * value)), 0), 6) as crest from m group by 1, 2, 3"""


@query(STATS_SQL)
def window_stats(spark, sf_dir):
    s = features.window_stats(windowed(spark, sf_dir), ["component_id", "segment", "window"], "value", "pos")
    return s.select("component_id", "segment", "window", "n", r6("mean"), r6("std"), "min", "max", r6("slope"), r6("rms"), F.round("kurtosis", 5).alias("kurtosis"), r6("crest"))


@query(f'with {WIN} select component_id, segment, "window", round(stddev_pop(value), 6) as rms_ac, round(greatest(max(value) - avg(value), avg(value) - min(value)) / nullif(stddev_pop(value), 0), 6) as crest_ac from win group by 1, 2, 3')
def window_stats_ac(spark, sf_dir):
    return features.window_stats_ac(windowed(spark, sf_dir), ["component_id", "segment", "window"], "value").select("component_id", "segment", "window", r6("rms_ac"), r6("crest_ac"))


@query(f"""with {TEL}, m as (select *, avg(value) over (partition by component_id) as mu from tel) select component_id, round(avg(pow(value - mu, 3)) / pow(avg(pow(value - mu, 2)), 1.5), 6) as skew, round(max(value) - min(value), 6) as p2p,
round(sqrt(avg(value * value)) / avg(abs(value)), 6) as shape, round(max(abs(value)) / avg(abs(value)), 6) as impulse, round(max(abs(value)) / pow(avg(sqrt(abs(value))), 2), 6) as margin from m group by 1""")
def shape_stats(spark, sf_dir):
    return features.shape_stats(telemetry(spark, sf_dir), ["component_id"], "value").select("component_id", *[r6(c) for c in ("skew", "p2p", "shape", "impulse", "margin")])


@query("""with x as (select l_orderkey, l_linenumber, l_quantity as v, count(*) over w - 1 as n, sum(l_quantity) over w - l_quantity as s, sum(l_quantity * l_quantity) over w - l_quantity * l_quantity as q from lineitem window w as (partition by l_orderkey)),
y as (select *, s / nullif(n, 0) as m, sqrt(greatest(q / nullif(n, 0) - pow(s / nullif(n, 0), 2), 0)) as sd from x) select l_orderkey, l_linenumber, round(case when n >= 2 then v - m end, 6) as peer_delta, round(case when n >= 2 and sd > 1e-6 then (v - m) / sd end, 5) as peer_z from y""")
def peer_normalise(spark, sf_dir):
    return features.peer_normalise(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity").select("l_orderkey", "l_linenumber", r6("peer_delta"), F.round("peer_z", 5).alias("peer_z"))


@query(f"with {TEL}, c as (select component_id, quantile_cont(value, 0.5) as centre, stddev_pop(value) as sd from tel group by 1), d as (select tel.component_id, any_value(centre) as centre, any_value(sd) as sd, quantile_cont(abs(value - centre), 0.5) * 1.4826 as mad from tel join c using (component_id) group by 1) select component_id, round(centre, 6) as centre, round(case when mad > 0 then mad when sd > 0 then sd else 1 end, 6) as spread from d")
def robust_baseline(spark, sf_dir):
    return features.robust_baseline(telemetry(spark, sf_dir), ["component_id"], "value").select("component_id", r6("centre"), r6("spread"))


@query(f"""with {TEL}, z as (select *, (value - 50) / 50 as z from tel), p as (select *, sum(z - 0.5) over w as u, sum(-z - 0.5) over w as d from z window w as (partition by component_id order by t, event_id rows unbounded preceding))
select event_id, round(greatest(u - least(0, min(u) over w), d - least(0, min(d) over w)), 5) as cusum from p window w as (partition by component_id order by t, event_id rows unbounded preceding)""")
def cusum_two_sided(spark, sf_dir):
    return features.cusum_two_sided(telemetry(spark, sf_dir), ["component_id"], ["t", "event_id"], (F.col("value") - 50) / 50).select("event_id", F.round("cusum", 5).alias("cusum"))


@query(f"""with recursive {TEL}, o as (select component_id, event_id, value, row_number() over (partition by component_id order by t, event_id) as i from tel),
e as (select component_id, event_id, i, value as ewma from o where i = 1 union all select o.component_id, o.event_id, o.i, coalesce(e.ewma * 0.8 + o.value * 0.2, o.value, e.ewma) from e join o on o.component_id = e.component_id and o.i = e.i + 1) select event_id, round(ewma, 6) as ewma from e""")
def ewma(spark, sf_dir):
    return features.ewma(telemetry(spark, sf_dir), ["component_id"], ["t", "event_id"], "value", 0.2).select("event_id", r6("ewma"))


@query(f"with {TEL} select event_id, round(quantile_cont(value, 0.5) over (partition by component_id order by t range between 259199999999 preceding and current row), 6) as rolling from tel")
def rolling_time_stat(spark, sf_dir):
    return features.rolling_median(telemetry(spark, sf_dir), ["component_id"], "t", "value", GAP3).select("event_id", r6("rolling"))


@query(f"with {TEL} select event_id, round(avg(value) over (partition by component_id order by t, event_id rows 4 preceding), 6) as smooth from tel")
def causal_moving_average(spark, sf_dir):
    return features.causal_moving_average(telemetry(spark, sf_dir), ["component_id"], ["t", "event_id"], "value", 5).select("event_id", r6("smooth"))


@query(f"""with {TEL}, i as (select *, row_number() over w - sum((value > 40)::int) over (partition by component_id order by t, event_id rows unbounded preceding) as isle from tel window w as (partition by component_id order by t, event_id)),
r as (select component_id, isle, min(t) as a, max(t) as b from i where value > 40 group by 1, 2) select component_id, min(a) + 86400000000 as at from r where b - a >= 86400000000 group by 1""")
def first_sustained(spark, sf_dir):
    return features.first_sustained(telemetry(spark, sf_dir), ["component_id"], ["t", "event_id"], "t", F.col("value") > 40, DAY_US)


@query(f"with {TEL}, p as (select component_id, signal, lag(signal) over (partition by component_id order by t, event_id) as q from tel) select component_id, coalesce(sum(case when signal <> q then 1 else 0 end) filter (where q is not null), null)::bigint as switches from p group by 1")
def mode_switch_count(spark, sf_dir):
    return features.mode_switch_count(telemetry(spark, sf_dir), ["component_id"], ["t", "event_id"], "signal")


@query(f"with {TEL}, c as (select component_id, signal, count(*) as n, row_number() over (partition by component_id order by count(*) desc, signal) as rn from tel group by 1, 2) select component_id, signal as label from c where rn = 1")
def majority_vote(spark, sf_dir):
    return features.majority_vote(telemetry(spark, sf_dir), ["component_id"], "signal")


@query(f"""with {TEL}, p as (select component_id, value, row_number() over (partition by component_id order by t, event_id) - 1 as p, count(*) over (partition by component_id) as n from tel),
b as (select component_id, c as blocks, p // (n // c) as b, value from p, (select unnest([5, 10, 20, 50, 100, 200]) as c) where n >= c), x as (select component_id, blocks, max(value) - min(value) as x from b where b < blocks group by component_id, blocks, b)
select component_id, blocks, round(avg(x), 6) as mean_extent from x group by 1, 2""")
def block_extrema(spark, sf_dir):
    return features.block_extrema(telemetry(spark, sf_dir), ["component_id"], ["t", "event_id"], "value").select("component_id", "blocks", r6("mean_extent"))


@query(f"with {TEL} select component_id, round(avg(case when signal = 'error' then 1.0 else 0.0 end), 6) as share, avg(case when signal = 'error' then 1.0 else 0.0 end) > 0.25 as excluded from tel group by 1")
def exclusive_mask_share(spark, sf_dir):
    s = F.avg((F.col("signal") == "error").cast("double"))
    return telemetry(spark, sf_dir).groupBy("component_id").agg(r6(s, "share"), (s > 0.25).alias("excluded"))


@query(f"with {TEL}, d as (select component_id, count(distinct signal) as k from tel group by 1) select count(*) as cases, round(avg(case when k <= 3 then 1.0 else 0.0 end), 6) as degenerate_share, avg(case when k <= 3 then 1.0 else 0.0 end) >= 0.5 as degenerate from d")
def degenerate_feature(spark, sf_dir):
    return features.degenerate_feature(telemetry(spark, sf_dir), "component_id", "signal").select("cases", r6("degenerate_share"), "degenerate")
