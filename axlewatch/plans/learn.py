"""Queries of change-point scores, classifiers, clusters, rules and forecasts over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from axlewatch.operators import changes, learners, segments
from axlewatch.plans.alarms import FEATURES, window_features
from axlewatch.plans.registry import query, r6
from axlewatch.sources.bind import FLT, TEL, fault_log, read, telemetry

LINE = ["l_quantity", "l_extendedprice", "l_discount"]
LINE_ID = ["l_orderkey", "l_linenumber"]
RATE, LENGTH = 1 / 72_000, 4  # a reading in twenty hours

POINTS = f"""{TEL}, p as (select component_id, row_number() over w - 1 as i, count(*) over (partition by component_id) as n, value, lag(value) over w as b from tel window w as (partition by component_id order by t, event_id)),
sz as (select component_id, count(*) as n from p group by 1), tr as (select component_id, i from p where (value > 100) <> (b > 100) and i > 0), gu as (select component_id, i from p where abs(value - b) > 80 and i > 0)"""


def points(spark, sf_dir):
    """Lengths of the components' series; where their readings cross 100; where they leap by over 80."""
    w = Window.partitionBy("component_id").orderBy("t", "event_id")
    p = telemetry(spark, sf_dir).select("component_id", (F.row_number().over(w) - 1).alias("i"), "value", F.lag("value").over(w).alias("b"))
    return p.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")), p.where((F.col("value") > 100) != (F.col("b") > 100)), p.where(F.abs(F.col("value") - F.col("b")) > 80)


@query(f"""with {POINTS}, c as (select 'a' as side, component_id, i from tr union select 'b', component_id, i from gu union select 'a', component_id, 0 from sz union select 'b', component_id, 0 from sz),
s as (select side, c.component_id, i as a, coalesce(lead(i) over (partition by side, c.component_id order by i), n) as z, n from c join sz using (component_id)),
j as (select x.component_id, x.a, x.z, x.n, max(greatest(least(x.z, y.z) - greatest(x.a, y.a), 0) / (x.z - x.a + y.z - y.a - greatest(least(x.z, y.z) - greatest(x.a, y.a), 0))::double) as j from s x join s y on x.component_id = y.component_id and x.side = 'a' and y.side = 'b' and x.a < y.z and y.a < x.z group by all)
select component_id, round(sum((z - a) * j) / any_value(n), 6) as covering from j group by 1""")
def cpd_covering(spark, sf_dir):
    sizes, truth, guess = points(spark, sf_dir)
    return changes.covering(sizes, truth, guess, ["component_id"], "n", "i").select("component_id", r6("covering"))


@query()
def cpd_metrics(spark, sf_dir):
    """Covering, F1 at a margin of five readings and its mean over ten margins, for each component."""
    sizes, truth, guess = points(spark, sf_dir)
    return changes.cpd_metrics(sizes, truth, guess, ["component_id"], "n", "i").select("component_id", *[r6(c) for c in ("covering", "f1", "mean_f1")], "n_true", "n_guess")


@query(f"""with {TEL}, {FLT}, s as (select *, case when t - lag(t) over w > {int(3 / RATE * 1_000_000)} then 1 else 0 end as cut from tel window w as (partition by component_id order by t, event_id)),
g as (select *, sum(cut) over (partition by component_id order by t, event_id rows unbounded preceding) as segment from s),
p as (select *, row_number() over (partition by component_id, segment order by t, event_id) - 1 as p, count(*) over (partition by component_id, segment) as n from g),
w as (select component_id, segment, k as "window", min(t) as t_start, max(t) as t_end, round(sum(value * (p - 2 * k + 1)), 4) as sample_sum from (select *, unnest(range(greatest(0, (p - 2) // 2), p // 2 + 1)) as k from p) where k <= (n - {LENGTH}) // 2 and n >= {LENGTH} and p between 2 * k and 2 * k + {LENGTH - 1} group by 1, 2, 3),
f as (select component_id, min(onset) as onset, min(failure) as failure from flt group by 1)
select component_id, segment::bigint as segment, "window"::int as "window", t_start, t_end, sample_sum, coalesce(t_end >= onset, false) as is_faulty, coalesce(t_end > failure, false) as post_failure from w left join f using (component_id)""")
def telemetry_windows(spark, sf_dir):
    """Windows of four readings, two apart, with labels; samples as a sum that depends on their order."""
    w = segments.telemetry_windows(telemetry(spark, sf_dir), fault_log(spark, sf_dir), ["component_id"], "component_id", "t", "value", "event_id", RATE, LENGTH, 2)
    placed = F.transform("samples", lambda v, i: v * (i + 1))
    return w.select("component_id", "segment", "window", "t_start", "t_end", F.round(F.aggregate(placed, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))), 4).alias("sample_sum"), "is_faulty", "post_failure")


def rule_node(name: str, rows: str) -> str:
    """A node of the rule tree in SQL: {name}_t holds its cut, {name}0 its extreme rows, {name}1 the others; no extreme rows for a leaf."""
    return f"""{name}_s as (select count(*) as n, [{', '.join(f'avg(x[{i}])' for i in (1, 2, 3))}] as mu, [{', '.join(f'stddev_pop(x[{i}])' for i in (1, 2, 3))}] as sd, [{', '.join(f'min(x[{i}])' for i in (1, 2, 3))}] as lo, [{', '.join(f'max(x[{i}])' for i in (1, 2, 3))}] as hi from {rows}),
{name}_z as (select *, list_transform([1, 2, 3], lambda i: greatest(hi[i] - mu[i], mu[i] - lo[i]) / (sd[i] + 1e-9)) as z from {name}_s),
{name}_f as (select n, list_position(z, list_max(z)) as f, hi[list_position(z, list_max(z))] - mu[list_position(z, list_max(z))] >= mu[list_position(z, list_max(z))] - lo[list_position(z, list_max(z))] as up from {name}_z),
{name}_t as (select any_value(f) as f, any_value(up) as up, any_value(n) as n, case when any_value(up) then quantile_cont(x[f], 0.95) else quantile_cont(x[f], 0.05) end as thr from {rows}, {name}_f),
{name}0 as (select r.* from {rows} r, {name}_t where n >= 4 and case when up then x[f] > thr else x[f] < thr end),
{name}1 as (select r.* from {rows} r, {name}_t where not coalesce(n >= 4 and case when up then x[f] > thr else x[f] < thr end, false))"""


def rule_way(name: str, below: tuple[str, str]) -> str:
    return f"(select case when exists (select 1 from {name}0) and case when up then a.x[f] > thr else a.x[f] < thr end then {below[0]} else {below[1]} end from {name}_t)"


@query(f"""with a as (select l_orderkey, l_linenumber, [{', '.join(f'{c}::double' for c in LINE)}] as x from lineitem), {rule_node('r', 'a')}, {rule_node('r0', 'r0')}, {rule_node('r1', 'r1')}
select l_orderkey, l_linenumber, round(-ln(({rule_way('r', (rule_way('r0', ('(select count(*) from r00)', '(select count(*) from r01)')), rule_way('r1', ('(select count(*) from r10)', '(select count(*) from r11)'))))} + 1) / ((select count(*) from a) + 1)::double), 6) as score from a""")
def det_rule_learner(spark, sf_dir):
    """How rare is the leaf of a line in a tree that peels off extreme quantities, prices and discounts?"""
    li = read(spark, sf_dir, "lineitem")
    return li.select(*LINE_ID, F.round(learners.rule_score(learners.rule_tree(li, LINE)), 6).alias("score"))


def training(df):
    """Whole orders, three in four."""
    return df.where(F.crc32(F.col("l_orderkey").cast("string")) % 4 != 0)


def judged(df):
    return df.where(F.crc32(F.col("l_orderkey").cast("string")) % 4 == 0)


SHIP = ["ship_day", "ship_open", "receipt_close", "l_quantity", "price_cruise"]


def lines(spark, sf_dir):
    """Lines of orders with features named by phase, to tell the status of a line."""
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01"))
    return read(spark, sf_dir, "lineitem").select(*LINE_ID, "l_linestatus", "l_returnflag", "l_quantity", day.alias("ship_day"), (day % 30).alias("ship_open"), (day % 7).alias("receipt_close"), (F.col("l_extendedprice") / 1000).alias("price_cruise"))


def first_probability(p, classes):
    return p.select(*LINE_ID, "predicted", *[F.round(F.get("probability", i), 4).alias(f"p{i}") for i in range(classes)])


@query()
def clf_logistic(spark, sf_dir):
    x = lines(spark, sf_dir)
    return first_probability(learners.logistic(training(x), SHIP, "l_returnflag").predicted(judged(x)), 3)


@query()
def clf_forest(spark, sf_dir):
    x = lines(spark, sf_dir)
    return first_probability(learners.forest(training(x), SHIP, "l_returnflag", trees=20, depth=6).predicted(judged(x)), 3)


@query()
def clf_boost(spark, sf_dir):
    """Boosters of two seeds, their probabilities averaged."""
    x = lines(spark, sf_dir)
    return first_probability(learners.boosted(training(x), [SHIP], "l_linestatus", seeds=(0, 1), rounds=10).predicted(judged(x)), 2)


@query()
def clf_three_regime(spark, sf_dir):
    """A booster for each of the groups of features that are named by a phase."""
    x = lines(spark, sf_dir)
    return first_probability(learners.three_regime(training(x), SHIP, "l_linestatus", rounds=10).predicted(judged(x)), 2)


@query()
def clf_stack(spark, sf_dir):
    x = lines(spark, sf_dir)
    whole, top = learners.stacked(training(x), SHIP, "l_linestatus", F.crc32(F.concat(F.lit("fold"), F.col("l_orderkey").cast("string"))) % 3)
    return first_probability(learners.stacked_probabilities(judged(x), whole, top), 2)


@query()
def det_kmeans(spark, sf_dir):
    w = window_features(spark, sf_dir)
    centres, _ = learners.clusters(w.where("component_id % 2 = 0"), FEATURES)
    return w.select("component_id", "segment", "window", F.round(learners.nearest_centre(FEATURES, centres), 6).alias("score"))


@query()
def det_cblof(spark, sf_dir):
    """How far is each window from the nearest large cluster?"""
    w = window_features(spark, sf_dir)
    centres, sizes = learners.clusters(w.where("component_id % 2 = 0"), FEATURES)
    large = [centres[i] for i in learners.large_clusters(sizes)]
    return w.select("component_id", "segment", "window", F.round(learners.nearest_centre(FEATURES, large), 6).alias("score"))


@query()
def det_forecast_residual(spark, sf_dir):
    """How far is the last of four readings, and its hour of the day, from what the three before foretell?"""
    t = telemetry(spark, sf_dir).withColumn("both", F.struct("value", (F.floor(F.col("t") / 3_600_000_000) % 24).cast("double").alias("hour")))
    w = segments.telemetry_windows(t, fault_log(spark, sf_dir), ["component_id"], "component_id", "t", "both", "event_id", RATE, LENGTH, 2)
    w = w.withColumns({"value": F.col("samples.value"), "hour": F.col("samples.hour")}).drop("samples").checkpoint()  # fitted on and scored
    m = learners.forecasts(w.where("not is_faulty"), ["value", "hour"], LENGTH, rounds=10)
    return learners.forecast_residuals(w, m, LENGTH).select("component_id", "segment", "window", r6("z_value"), r6("z_hour"), r6("score"), "channel")


@query(f"""with v as (select *, l_linenumber % 4 = 0 as val from lineitem), g as (select distinct l_returnflag as fold from v),
f as (select fold, {', '.join(f'avg({c}) as {c}_m, stddev_pop({c}) as {c}_d' for c in LINE)} from g join v on l_returnflag <> fold where not val group by 1),
s as (select v.*, fold, greatest({', '.join(f'abs({c} - {c}_m) / nullif({c}_d, 0)' for c in LINE)}) as score from v, f),
h as (select fold, quantile_cont(score, 0.99) as threshold from s where fold <> l_returnflag and val group by 1)
select l_orderkey, l_linenumber, l_returnflag, round(score, 6) as score, round(threshold, 6) as threshold, score > threshold + 1e-9 as alert from s join h using (fold) where fold = l_returnflag""")
def leave_one_train_scoring(spark, sf_dir):
    """Lines scored by a fit on the other return flags, against a threshold from those flags' lines that are kept from the fit."""
    s = learners.leave_one_out_scores(read(spark, sf_dir, "lineitem"), "l_returnflag", LINE_ID, LINE, F.col("l_linenumber") % 4 == 0)
    return s.select(*LINE_ID, "l_returnflag", r6("score"), r6("threshold"), (F.col("score") > F.col("threshold") + 1e-9).alias("alert"))
