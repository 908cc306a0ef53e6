"""Queries of detectors with a fitted model over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from axlewatch.operators import fitted
from axlewatch.plans.alarms import FEATURES, window_features
from axlewatch.plans.registry import query
from axlewatch.sources.bind import TEL, read, telemetry

M = 8
LINE = ["l_quantity", "l_extendedprice", "l_discount"]


@query(f"""with {TEL}, p as (select component_id, value, row_number() over (partition by component_id order by t, event_id) - 1 as p from tel where value is not null and not isnan(value)),
s as (select component_id, p - {M - 1} as i, list(value) over w as xs, count(*) over w as n from p window w as (partition by component_id order by p rows between {M - 1} preceding and current row)),
z as (select component_id, i, case when list_stddev_pop(xs) > 1e-12 then list_transform(xs, lambda x: (x - list_avg(xs)) / list_stddev_pop(xs)) else list_transform(xs, lambda x: 0::double) end as z from s where n = {M})
select a.component_id, a.i, round(min(sqrt(greatest(list_inner_product(a.z, a.z) + list_inner_product(b.z, b.z) - 2 * list_inner_product(a.z, b.z), 0))), 4) as distance from z a join z b on a.component_id = b.component_id and abs(a.i - b.i) >= {M // 4} group by 1, 2""")
def det_discord(spark, sf_dir):
    """How far is each stretch of eight readings from the nearest other one of its component?"""
    t = telemetry(spark, sf_dir)
    return fitted.discords(t, t, ["component_id"], ["t", "event_id"], "value", M, itself=True).select("component_id", "i", F.round("distance", 4).alias("distance"))


@query()
def det_isolation_forest(spark, sf_dir):
    w = window_features(spark, sf_dir).withColumns({c: F.round(c, 9) for c in FEATURES}).withColumn("id", F.concat_ws("-", "component_id", "segment", "window")).checkpoint()
    forest = fitted.isolation_forest(w, "id", FEATURES)
    return fitted.isolation_scores(w, forest, ["component_id", "segment", "window"], FEATURES)


@query()
def det_robust_mahalanobis(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return fitted.robust_mahalanobis(li, li, LINE).select("l_orderkey", "l_linenumber", "l_partkey", F.round("score", 6).alias("score"))


@query()
def det_pca_spe_t2(spark, sf_dir):
    w = window_features(spark, sf_dir)
    p = fitted.pca_spe_t2(w, w.where("component_id % 2 = 0"), FEATURES)
    return p.select("component_id", "segment", "window", F.round("score", 6).alias("score"))
