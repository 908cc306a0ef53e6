"""Queries of strokes, recordings and ranks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from axlewatch.operators import rankers, strokes
from axlewatch.plans.registry import query, r6
from axlewatch.sources.bind import TEL, read, telemetry

V = f"""{TEL}, v as (select component_id, event_id, value as x, event_id % 97 - 48 as cur, event_id % 13 - 6 as err, row_number() over w as i, lead(value) over w - value as d from tel where value is not null window w as (partition by component_id order by t, event_id)),
pk as (select component_id, quantile_cont(abs(d), 0.95) as pk from v where d <> 0 group by 1), sg as (select v.*, case when d is null then null when round(d, 9) > round(0.05 * pk, 9) then 1 when round(d, 9) < -round(0.05 * pk, 9) then -1 else 0 end as g from v join pk using (component_id)),
ct as (select *, (g is distinct from lag(g) over (partition by component_id order by i))::int as b from sg), rn as (select *, sum(b) over (partition by component_id order by i) as run from ct),
sp as (select component_id, run, min(i) as a, max(i) + 1 as z from rn where g <> 0 group by 1, 2), st as (select sp.component_id, sp.run, v.i - sp.a as pos, event_id, x, cur, err from sp join v on v.component_id = sp.component_id and v.i between a and z where z - a + 1 >= 3)"""


def stroke_rows(spark, sf_dir):
    return strokes.monotone_strokes(telemetry(spark, sf_dir), ["component_id"], "t", "value", "event_id")


@query(f"with {V} select component_id, count(distinct run) as strokes, count(*) as n_rows, sum(event_id * (pos + 1)) as places from st group by 1")
def monotone_strokes(spark, sf_dir):
    return stroke_rows(spark, sf_dir).groupBy("component_id").agg(F.count_distinct("stroke").alias("strokes"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("event_id") * (F.col("pos") + 1)).alias("places"))


@query(f"""with {V}, f as (select component_id, run, count(*) as n, arg_min(x, pos) as x0, arg_max(x, pos) as x1, max(x) - min(x) as rg, avg(abs(cur)) as im, sqrt(avg(cur * cur)) as ir, max(abs(cur)) as ip, max(abs(cur)) filter (pos < 5) as isp, max(abs(err)) as em, sqrt(avg(err * err)) as er from st group by 1, 2)
select component_id, n as n_samples, round(n / 10.0, 6) as duration_s, round(im, 6) as i_mean, round(ir, 6) as i_rms, ip as i_peak, isp as i_start_peak, round(x0, 6) as pos_ref_start, round(x1, 6) as pos_ref_end, round(rg, 6) as pos_ref_range, sign(x1 - x0)::int as direction, round(abs(x1 - x0) * 10 / (n - 1), 5) as v_ref, em as pos_err_max, round(er, 6) as pos_err_rms from f""")
def stroke_features(spark, sf_dir):
    x = stroke_rows(spark, sf_dir).withColumn("current", F.col("event_id") % 97 - 48).withColumn("error", F.col("event_id") % 13 - 6)
    f = strokes.stroke_features(x, ["component_id"], "current", "value", "error", 10.0)
    return f.select("component_id", "n_samples", *[r6(c) for c in ("duration_s", "i_mean", "i_rms")], "i_peak", "i_start_peak", *[r6(c) for c in ("pos_ref_start", "pos_ref_end", "pos_ref_range")], "direction", F.round("v_ref", 5).alias("v_ref"), "pos_err_max", r6("pos_err_rms"))


@query(f"""with {TEL}, p as (select component_id, coalesce((value > 50)::int, 0) as h, row_number() over (partition by component_id order by t, event_id) - 1 as i, count(*) over (partition by component_id) as n from tel), e as (select component_id, n, i // 10 as w, abs(h - lag(h) over (partition by component_id, i // 10 order by i)) as e from p where n < 10 or i // 10 < n // 10)
select component_id, w as "window", coalesce(sum(e), 0)::bigint as n_edges, round(coalesce(sum(e), 0) / 2 * 0.03 / (count(*) / 100.0) * 3.6, 6) as speed_kmh from e group by 1, 2""")
def tacho_windows(spark, sf_dir):
    x = strokes.tacho_windows(telemetry(spark, sf_dir), ["component_id"], "t", F.col("value") > 50, "event_id", 10, 100.0, 0.03)
    return x.select("component_id", "window", "n_edges", r6("speed_kmh"))


@query("""with r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity) as r from lineitem), f as (select l_orderkey, sha256(string_agg(coalesce(trunc(l_quantity)::bigint::varchar, ''), ',' order by r)) as fingerprint from r where r <= 1000 group by 1)
select fingerprint, min(l_orderkey) as first, count(*) as n from f group by 1 having count(*) > 1""")
def recording_fingerprint(spark, sf_dir):
    """Orders whose first lines have the same quantities."""
    f = strokes.recording_fingerprint(read(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_quantity"], F.col("l_quantity").cast("long"))
    return strokes.duplicate_groups(f, "l_orderkey")


@query("""with m as (select l_orderkey, l_returnflag, quantile_cont(l_quantity, 0.5) as m from lineitem where l_tax >= 0.02 group by 1, 2), g as (select l_returnflag, count(m) as n, quantile_cont(m, 0.5) as median, quantile_cont(m, 0.1) as p10, quantile_cont(m, 0.9) as p90 from m group by 1)
select l_returnflag, n, median, p10, p90, round(median / nullif((select max(median) from g where l_returnflag = 'N'), 0), 6) as ratio from g""")
def record_group_stats(spark, sf_dir):
    x = strokes.record_group_stats(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", "l_quantity", F.col("l_tax") >= 0.02, "N")
    return x.withColumn("ratio", r6("ratio"))


@query("""with p as (select l_suppkey, l_orderkey, median(l_quantity) as x, median(l_extendedprice) as y from lineitem group by 1, 2), q as (select l_suppkey, x, ln(x) as lx, ln(y) as ly from p where x > 0 and y > 0), a as (select l_suppkey, count(*) as n, regr_slope(ly, lx) as alpha, regr_intercept(ly, lx) as intercept, regr_sxx(ly, lx) as sxx, regr_syy(ly, lx) as syy, regr_r2(ly, lx) as r2, min(x) as x_lo, max(x) as x_hi from q group by 1)
select l_suppkey, n, round(alpha, 5) as alpha, round(intercept, 5) as intercept, round(r2, 5) as r2, x_lo, x_hi, round(sqrt(greatest(0, (1 - r2) * syy) / (n - 2) / sxx), 5) as stderr from a where n >= 3 and x_lo < x_hi""")
def power_law_fit(spark, sf_dir):
    per = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.median("l_quantity").alias("x"), F.median("l_extendedprice").alias("y"))
    x = strokes.power_law_fit(per, ["l_suppkey"], "x", "y")
    return x.select("l_suppkey", "n", *[F.round(c, 5).alias(c) for c in ("alpha", "intercept", "r2", "stderr")], "x_lo", "x_hi")


RANK = "row_number() over (partition by l_orderkey order by case when l_discount > 0 then round(s, 9) end desc nulls last, l_extendedprice desc nulls last, l_linenumber::varchar)"
WEIGHTS = {"l_quantity": 1.0, "tax": 0.5}  # whole numbers: medians and their differences are exact
TAX = "li as (select *, round(l_tax * 100) as tax from lineitem)"


def _lines(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").withColumn("tax", F.round(F.col("l_tax") * 100))


def _ranked(x):
    x = rankers.rank_case(x.withColumn("score", F.round("score", 9)), ["l_orderkey"], "score", ["l_extendedprice"], "l_linenumber", F.col("l_discount") > 0)
    return x.select("l_orderkey", "l_linenumber", "score", "rank")


@query(f"""with {TAX}, m as (select l_orderkey, {', '.join(f'quantile_cont({c}, 0.5) as m_{c}, max({c}) - min({c}) as g_{c}' for c in WEIGHTS)} from li group by 1), d as (select l_orderkey, {', '.join(f'quantile_cont(abs({c} - m_{c}), 0.5) * 1.4826 as s_{c}' for c in WEIGHTS)} from li join m using (l_orderkey) group by 1),
z as (select li.*, {' + '.join(f'coalesce({w} * ({c} - m_{c}) / case when s_{c} > 0 then s_{c} when g_{c} > 0 then g_{c} else 1 end, 0)' for c, w in WEIGHTS.items())} as s from li join m using (l_orderkey) join d using (l_orderkey))
select l_orderkey, l_linenumber, case when l_discount > 0 then round(s, 9) + 0.0 end as score, {RANK} as rank from z""")
def acv_rank_zsum(spark, sf_dir):
    return _ranked(rankers.zsum_score(_lines(spark, sf_dir), ["l_orderkey"], WEIGHTS))


@query(f"""with {TAX}, b as (select *, count(*) over (partition by l_orderkey) as n, {', '.join(f'rank() over (partition by l_orderkey order by {c} desc) + (count(*) over (partition by l_orderkey, {c}) - 1) / 2 as r_{c}' for c in WEIGHTS)} from li), z as (select *, {' + '.join(f'coalesce({w} * (n - r_{c}) / n, 0)' for c, w in WEIGHTS.items())} as s from b)
select l_orderkey, l_linenumber, case when l_discount > 0 then round(s, 9) + 0.0 end as score, {RANK} as rank from z""")
def acv_rank_borda(spark, sf_dir):
    return _ranked(rankers.borda_score(_lines(spark, sf_dir), ["l_orderkey"], WEIGHTS))


@query("""with c as (select l_orderkey, count(*) as n, coalesce(nullif(count(*) filter (l_discount > 0), 0), count(*)) as k from lineitem group by 1) select round(avg((n + 1) / (2 * n)), 6) as uniform, round(avg((2 * n - k + 1) / (2 * n)), 6) as blind from c""")
def chance_floor_rank(spark, sf_dir):
    return rankers.chance_floor_rank(read(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_discount") > 0).select(r6("uniform"), r6("blind"))


@query("""with c as (select l_suppkey as fold, l_linenumber as place, floor(avg(round(l_tax * 100))) as score, floor(10 * avg((l_discount > 0.05)::int)) as top1, stddev_pop(l_quantity) as sep, count(distinct l_returnflag) as features from lineitem group by 1, 2), r as (select *, count(*) over (partition by fold, score, top1) as n_tied, row_number() over (partition by fold order by score desc, top1 desc, round(sep, 6) desc, features, place) as r from c)
select fold, place, score, top1, features, n_tied from r where r = 1""")
def select_ranker(spark, sf_dir):
    c = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("fold"), F.col("l_linenumber").alias("place")).agg(F.floor(F.avg(F.round(F.col("l_tax") * 100))).cast("double").alias("score"), F.floor(10 * F.avg((F.col("l_discount") > 0.05).cast("int"))).cast("double").alias("top1"), F.stddev_pop("l_quantity").alias("sep"), F.count_distinct("l_returnflag").alias("features"))
    return rankers.select_ranker(c, ["fold"], "score", "top1", "sep", "features", "place").select("fold", "place", "score", "top1", "features", "n_tied")


@query("""with p as (select l_suppkey, avg((l_quantity > 40)::int) as vus, avg((l_quantity > 40)::int) filter (l_returnflag = 'R') as val, avg((l_returnflag = 'A')::int) as base, avg((l_returnflag = 'R')::int) as val_base from lineitem group by 1)
select l_suppkey, round(case when base > 0 then vus / base end, 6) as lift_vus, round(case when val_base > 0 then val / val_base end, 6) as lift_val from p""")
def lift_table(spark, sf_dir):
    big, flag = (F.col("l_quantity") > 40).cast("int"), F.col("l_returnflag")
    p = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg(big).alias("vus"), F.avg(F.when(flag == "R", big)).alias("val"), F.avg((flag == "A").cast("int")).alias("base"), F.avg((flag == "R").cast("int")).alias("val_base"))
    return rankers.lift_table(p, {"vus": "base", "val": "val_base"}).select("l_suppkey", r6("lift_vus"), r6("lift_val"))


@query("select event_id, round(('0x' || substr(md5(event_id || '-7'), 1, 8))::ubigint / 4294967296, 9) as score from events")
def det_random(spark, sf_dir):
    return rankers.random_score(telemetry(spark, sf_dir), F.col("event_id"), 7).select("event_id", F.round("score", 9).alias("score"))
