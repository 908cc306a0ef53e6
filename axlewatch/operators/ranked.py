"""Running sums over a whole table in order of a value, without a task that sees all of it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A quantile's sketch is right to one in so many ranks.
SKETCH = 10_000
#: So many values of a bracket are ranked in one task, more over ranges.
ONE_TASK = 100_000
#: Rows that a task of `dealt` sorts, about.
TASK_ROWS = 500_000


def dealt(df: DataFrame, keys: list[str], size: DataFrame | None = None, times: int = 1) -> DataFrame:
    """df dealt by keys into as many tasks as its rows call for, so that a task's sorts don't grow with the table.

    size: a table that is cheaper to count, of which df has at most `times` the rows. Later windows and groups by keys, or by more than keys, stay in their task.
    """
    n = (df if size is None else size).count() * times
    return df.repartition(max(n // TASK_ROWS + 1, df.sparkSession.sparkContext.defaultParallelism), *keys)


def running_sums(df: DataFrame, order: list[str], sums: dict[str, Column], groups: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds for each name the sum of its column over the rows of the same group up to this one, in the given order (equal rows together).

    Rows are dealt into ranges of the order; each range is summed inside, and what stands before it is a sum of the ranges'
    totals, a row per range and group. The ranges are written once, so a lost executor can't deal them anew.
    """
    g = df.withColumns({f"_v_{k}": c for k, c in sums.items()}).repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    total = g.groupBy(*groups, "_part").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    ahead = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = total.select(*[F.col(k).alias(f"_g_{k}") for k in groups], F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_t_{k}").over(ahead), F.lit(0)).alias(f"_b_{k}") for k in sums])
    on = F.col("_part") == F.col("_p")
    for k in groups:
        on = on & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    inside = Window.partitionBy(*groups, "_part").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = g.join(F.broadcast(before), on)  # at most a row per range and group
    return out.select(*df.columns, *[(F.col(f"_b_{k}") + F.sum(f"_v_{k}").over(inside)).alias(k) for k in sums])


def order_statistics(df: DataFrame, value: str, names: dict[str, float], groups: list[str] = []) -> DataFrame:  # noqa: B006
    """One row (or a row per group) of exact quantiles: a column for each name, interpolated between neighbours; NULLs don't count.

    Values are counted before they are put in order, ranks are running sums over ranges, and a quantile is a minimum over
    the values beyond its rank, so no task and no buffer holds a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    upto = running_sums(counts, ["_x"], {"_upto": F.col("_c")}, groups)
    total = counts.groupBy(*[F.col(g).alias(f"_q_{g}") for g in groups]).agg(F.sum("_c").alias("_n"))
    on = F.lit(True)
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_q_{g}"))
    ranked = upto.join(total, on) if groups else upto.join(F.broadcast(total))  # one row without groups
    at = {n: (F.col("_n") - 1) * q for n, q in names.items()}
    picked = ranked.groupBy(*groups).agg(F.first("_n").alias("_n"), *[F.min(F.when(F.col("_upto") > f(at[n]), F.col("_x"))).alias(f"_{s}_{n}") for n in names for s, f in (("lo", F.floor), ("hi", F.ceil))])
    part = {n: at[n] - F.floor(at[n]) for n in names}
    return picked.select(*groups, *[F.when(F.col(f"_lo_{n}") == F.col(f"_hi_{n}"), F.col(f"_lo_{n}").cast("double")).otherwise((1 - part[n]) * F.col(f"_lo_{n}") + part[n] * F.col(f"_hi_{n}")).alias(n) for n in names])


def quantile(df: DataFrame, value: str, q: float) -> float | None:
    """An exact quantile of a table as `order_statistics` gives it, without putting the whole table in order.

    A sketch tells a bracket of some 0.06 % of the rows; one aggregate counts what lies below it and its distinct values, which
    alone are ranked. If the wanted ranks lie outside of the bracket, all values are.
    """
    v, edge = F.col(value), 3 / SKETCH
    n, bracket = df.agg(F.count(v), F.percentile_approx(v, [max(q - edge, 0.0), min(q + edge, 1.0)], SKETCH)).first()
    if not n:
        return None
    at = (n - 1) * q
    lo, hi = F.lit(bracket[0]), F.lit(bracket[1])
    g = df.where(v <= hi).groupBy(F.when(v >= lo, v).alias("_x")).agg(F.count(F.lit(1)).alias("_c")).checkpoint()
    below, distinct = g.agg(F.coalesce(F.sum(F.when(F.col("_x").isNull(), F.col("_c"))), F.lit(0)), F.count("_x")).first()
    g = g.where("_x is not null")
    upto = g.select("_x", F.sum("_c").over(Window.orderBy("_x")).alias("_upto")) if distinct <= ONE_TASK else running_sums(g, ["_x"], {"_upto": F.col("_c")})
    low, high = upto.agg(*[F.min(F.when(F.col("_upto") + below > r, F.col("_x"))) for r in (math.floor(at), math.ceil(at))]).first()
    if below > math.floor(at) or low is None or high is None:
        return order_statistics(df, value, {"q": q}).first().q
    part = at - math.floor(at)
    return float(low) if low == high else float((1 - part) * low + part * high)
