"""Air conditioning of the cars of a train over time: masks of usable readings and how fast a car cools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def case_masks(df: DataFrame, case: str, car: str, time: str, indoor: str, outdoor: str, cooling: Column, valid: Column, rows: int, hot_quantile: float = 0.5) -> DataFrame:
    """Adds usable (valid, cooling, with a reading), steady and hot.

    steady: the deviation over `rows` readings around is at most the case's median of it; hot: the median outdoor reading of
    all cars at the time (indoor in a case that has none) is at least the case's quantile of it; all rows if there is none.
    """
    around = Window.partitionBy(case, car).orderBy(time).rowsBetween(-(rows // 2), (rows - 1) // 2)
    x = df.withColumn("_sd", F.when(F.count(indoor).over(around) >= max(rows // 2, 2), F.stddev_samp(indoor).over(around)))
    at = df.groupBy(case, time).agg(F.percentile(outdoor, 0.5).alias("_o"), F.percentile(indoor, 0.5).alias("_i"))
    has = at.groupBy(case).agg(F.count("_o").alias("_n"))
    at = at.join(has, case).withColumn("_d", F.when(F.col("_n") > 0, F.col("_o")).otherwise(F.col("_i")))
    cut = at.groupBy(case).agg(F.percentile("_d", hot_quantile).alias("_cut"))
    calm = x.groupBy(case).agg(F.percentile("_sd", 0.5).alias("_calm"))
    j = x.join(at.select(case, time, "_d"), [case, time]).join(cut, case).join(calm, case)
    return j.select(
        *df.columns, F.coalesce(valid & cooling & F.col(indoor).isNotNull(), F.lit(False)).alias("usable"),
        F.when(F.col("_calm").isNull(), F.col(indoor).isNotNull()).otherwise(F.coalesce(F.col("_sd") <= F.col("_calm"), F.lit(False))).alias("steady"),
        F.when(F.col("_cut").isNull(), True).otherwise(F.coalesce(F.col("_d") >= F.col("_cut"), F.lit(False))).alias("hot"),
    )


def pulldown_penalty(df: DataFrame, case: str, car: str, time: str, indoor: str, demanding: Column, step: int, hours: float) -> DataFrame:
    """case, car, penalty: the negated mean rise per hour over the next `step` readings while demanding, less the median of the case's cars."""
    ahead = F.lead(indoor, step).over(Window.partitionBy(case, car).orderBy(time))
    rate = df.withColumn("_r", (ahead - F.col(indoor)) / hours)
    by = rate.groupBy(case, car).agg((-F.avg(F.when(demanding, F.col("_r")))).alias("_p"))
    return by.join(by.groupBy(case).agg(F.percentile("_p", 0.5).alias("_m")), case).select(case, car, (F.col("_p") - F.col("_m")).alias("penalty"))
