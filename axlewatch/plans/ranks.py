"""Queries of baselines fitted by aggregates, fits of lines, ranks and held statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from axlewatch.operators import features
from axlewatch.plans.registry import query, r6
from axlewatch.sources.bind import DAY_US, TEL, read, telemetry


@query("""with b as (select l_returnflag, regr_slope(l_extendedprice, ln(l_quantity)) as a, regr_intercept(l_extendedprice, ln(l_quantity)) as c from lineitem where l_linestatus = 'O' group by 1)
select l_orderkey, l_linenumber, round(l_extendedprice - (a * ln(l_quantity) + c), 3) as residual from lineitem left join b using (l_returnflag)""")
def speed_baseline_residual(spark, sf_dir):
    """Residual from a line in log speed, fitted on normal rows; a model row for each class, broadcast."""
    li = read(spark, sf_dir, "lineitem").withColumn("x", F.log("l_quantity"))
    b = li.where("l_linestatus = 'O'").groupBy("l_returnflag").agg(F.regr_slope("l_extendedprice", "x").alias("a"), F.regr_intercept("l_extendedprice", "x").alias("c"))
    return li.join(F.broadcast(b), "l_returnflag", "left").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") - (F.col("a") * F.col("x") + F.col("c")), 3).alias("residual"))


@query("select l_orderkey, l_linenumber, case when l_quantity < 5 then 'normal' when l_discount * 2 >= l_tax * 3 and l_discount * 2 >= 0.05 then 'one' when l_tax * 3 >= 0.05 then 'two' else 'normal' end as label from lineitem")
def decision_rules(spark, sf_dir):
    """The first largest of boosted class scores; slow rows are normal."""
    one, two, none = F.col("l_discount") * 2, F.col("l_tax") * 3, F.lit(0.05)
    label = F.when(F.col("l_quantity") < 5, "normal").when((one >= two) & (one >= none), "one").when(two >= none, "two").otherwise("normal")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", label.alias("label"))


@query("""with g as (select m, o_orderkey, ln(sum(pow(l_quantity / 2, m))) as x, ln(any_value(o_totalprice)) as y from lineitem join orders on l_orderkey = o_orderkey, (select unnest([1.0, 3.0, 5.0]) as m) group by 1, 2)
select cast(m as double) as exponent, count(*) as n, round(regr_slope(y, x), 5) as slope, round(regr_intercept(y, x), 5) as intercept, round(regr_r2(y, x), 5) as r2 from g group by 1""")
def reg_miner_line(spark, sf_dir):
    """A line log D = a x + b for each exponent; all exponents in one pass over the rows."""
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders").where("o_totalprice > 0").select("o_orderkey", "o_totalprice")
    sums = li.groupBy("l_orderkey").agg(*[F.sum(F.pow(F.col("l_quantity") / 2, F.lit(m))).alias(f"m{int(m)}") for m in (1.0, 3.0, 5.0)])
    j = sums.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    g = j.select(F.log("o_totalprice").alias("y"), F.explode(F.array(*[F.struct(F.lit(m).alias("exponent"), F.log(f"m{int(m)}").alias("x")) for m in (1.0, 3.0, 5.0)])).alias("e")).select("y", "e.*")
    return g.groupBy("exponent").agg(F.count(F.lit(1)).alias("n"), *[F.round(f("y", "x"), 5).alias(a) for a, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept), ("r2", F.regr_r2))])


@query("""with s as (select s_nationkey, s_suppkey, s_acctbal, lead(s_acctbal) over w as next, row_number() over w as rank from supplier window w as (partition by s_nationkey order by s_acctbal desc, s_suppkey))
select s_nationkey, s_suppkey, round(s_acctbal - next, 4) as margin from s where rank = 1""")
def mode_margin(spark, sf_dir):
    """The best of each case and its lead over the second."""
    w = Window.partitionBy("s_nationkey").orderBy(F.col("s_acctbal").desc(), "s_suppkey")
    s = read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal", F.lead("s_acctbal").over(w).alias("next"), F.row_number().over(w).alias("rank"))
    return s.where("rank = 1").select("s_nationkey", "s_suppkey", F.round(F.col("s_acctbal") - F.col("next"), 4).alias("margin"))


@query(f"""with {TEL}, d as (select *, value > 40 as o, value - 40 as z, row_number() over w - sum((value > 40)::int) over (partition by component_id order by t, event_id rows unbounded preceding) as isle from tel window w as (partition by component_id order by t, event_id)),
c as (select *, sum(z - 0.5) over w as p, t - min(t) over (partition by component_id, isle) as held from d where o window w as (partition by component_id, isle order by t, event_id rows unbounded preceding))
select event_id, round(case when held >= {DAY_US} then p - least(0, min(p) over (partition by component_id, isle order by t, event_id rows unbounded preceding)) else 0 end, 5) as score from c""")
def held_cusum(spark, sf_dir):
    """CUSUM inside each crossing, 0 until it has held for a day."""
    over = F.col("value") > 40
    return features.held_cusum(telemetry(spark, sf_dir), ["component_id"], ["t", "event_id"], "t", F.col("value") - 40, over, DAY_US).select("event_id", F.round("score", 5).alias("score"))


@query("with e as (select quantile_cont(p_retailprice, 0.25) as a, quantile_cont(p_retailprice, 0.5) as b, quantile_cont(p_retailprice, 0.75) as c from part where p_size > 25) select p_partkey, case when p_retailprice < a then 0 when p_retailprice < b then 1 when p_retailprice < c then 2 else 3 end as fold from part, e")
def speed_band_out(spark, sf_dir):
    """Fold by quantile band of the faulty rows' speeds; the edges are one row."""
    p = read(spark, sf_dir, "part")
    e = p.where("p_size > 25").agg(*[F.percentile("p_retailprice", q).alias(n) for n, q in (("a", 0.25), ("b", 0.5), ("c", 0.75))])
    x = F.col("p_retailprice")
    return p.join(F.broadcast(e)).select("p_partkey", F.when(x < F.col("a"), 0).when(x < F.col("b"), 1).when(x < F.col("c"), 2).otherwise(3).alias("fold"))


@query("select strftime(l_shipdate, '%Y-%m-%d') as day, round(avg(l_discount), 6) as mean, cast(count(distinct l_linestatus) as bigint) as n_labels, count(*) as n from lineitem group by 1 having count(distinct l_linestatus) > 1")
def duplicate_report(spark, sf_dir):
    """Groups that share a key but not a label."""
    g = read(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(r6(F.avg("l_discount"), "mean"), F.size(F.collect_set("l_linestatus")).cast("bigint").alias("n_labels"), F.count(F.lit(1)).alias("n"))
    return g.where("n_labels > 1")
