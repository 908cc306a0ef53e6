"""As-of, interval and range joins, always with the component as an equality key."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Adds to left the values of the last right row at or before its time. One shuffle: union, then a running last."""
    held = F.struct(F.col(right_time).alias("_rt"), *values)
    r = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), held.alias("_held"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"))
    l = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_held"].dataType).alias("_held"), F.struct("*").alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side", F.col("_held._rt"), *[F.col(f"_held.{v}") for v in values]).rowsBetween(Window.unboundedPreceding, 0)
    u = r.unionByName(l).withColumn("_last", F.last("_held", ignorenulls=True).over(w)).where("_side = 1")
    return u.select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def label_from_fault_log(rows: DataFrame, faults: DataFrame, gamma: float = 2.0, alarm_us: int = 3 * 86_400_000_000) -> DataFrame:
    """rows(component_id, t) labelled by the latest onset at or before t: severity u^gamma, rul, is_faulty, alarm. An unknown failure leaves rul NULL and no alarm."""
    f = faults.where("onset is not null").select("component_id", "onset", "failure")
    j = asof_backward(rows, f, ["component_id"], "t", "onset", ["onset", "failure"])
    inside = F.col("onset").isNotNull() & (F.col("failure").isNull() | (F.col("t") <= F.col("failure")))
    u = (F.col("t") - F.col("onset")) / (F.col("failure") - F.col("onset"))
    return j.withColumn("is_faulty", inside).withColumn("severity", F.when(inside, F.coalesce(F.pow(u, gamma), F.lit(1.0))).otherwise(F.lit(0.0))).withColumn(
        "rul_s", F.when(inside, (F.col("failure") - F.col("t")) / 1e6)
    ).withColumn("alarm", F.coalesce(inside & (F.col("failure") - F.col("t") <= alarm_us), F.lit(False)))


def reached(rows: DataFrame, spans: DataFrame, keys: list[str], at: Column, start: Column, end: Column) -> DataFrame:
    """Adds _reach: the greatest end of the spans of the same keys that start at or before `at`; NULL if none does.

    A span that starts by `at` and ends no earlier than some point exists if and only if _reach is no earlier, so this one
    union and running maximum answers whether any span covers or overlaps, however many spans a series has.
    """
    known = [start.isNotNull(), end.isNotNull(), *[F.col(k).isNotNull() for k in keys]]
    s = spans.where(functools.reduce(Column.__and__, known)).select(*keys, start.alias("_t"), F.lit(0).alias("_side"), end.alias("_end"), F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType).alias("_row"))
    r = rows.select(*keys, at.alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(s.schema["_end"].dataType).alias("_end"), F.struct("*").alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return s.unionByName(r).withColumn("_reach", F.max("_end").over(w)).where("_side = 1").select("_row.*", "_reach")


def in_cells(df: DataFrame, start: Column, end: Column, cell: int) -> DataFrame:
    """Adds _cell: a row for each cell of time of this width that [start, end] touches."""
    return df.where(start <= end).withColumn("_cell", F.explode(F.sequence(F.floor(start / cell), F.floor(end / cell))))


def label_from_events(rows: DataFrame, faults: DataFrame, cell: int = 2 * 86_400_000_000) -> DataFrame:
    """Labels by containment in a fault's interval: is_faulty, the least rul, and the last fault in log order.

    Rows meet the faults of their own cell of time only; a cell should be about as long as a fault.
    """
    f = in_cells(faults.select(F.col("component_id").alias("_c"), "onset", "failure", "fault_id"), F.col("onset"), F.col("failure"), cell)
    j = rows.withColumn("_at", F.floor(F.col("t") / cell)).join(f, (F.col("component_id") == F.col("_c")) & (F.col("_at") == F.col("_cell")) & F.col("t").between(F.col("onset"), F.col("failure")), "left")
    return j.groupBy("event_id", "component_id", "t").agg(F.max(F.col("fault_id").isNotNull()).alias("is_faulty"), F.min((F.col("failure") - F.col("t")) / 1e6).alias("rul_s"), F.max("fault_id").alias("fault_id"))


def overlaps_fault(spans: DataFrame, faults: DataFrame, key: str, before_us: int = 0) -> DataFrame:
    """spans(key, t_start, t_end, component_id) that overlap a fault's interval, widened by before_us at its onset."""
    x = reached(spans, faults.select("component_id", "onset", "failure"), ["component_id"], F.col("t_end"), F.col("onset") - before_us, F.col("failure"))
    return x.where(F.col("_reach") >= F.col("t_start")).select(*spans.columns)


def match_episodes(episodes: DataFrame, faults: DataFrame, horizon_us: int, cell: int = 4 * 86_400_000_000) -> DataFrame:
    """Adds fault_id, matched and lead_h: the first fault in log order whose detection window [onset - H, failure] an episode overlaps claims it. Both meet in cells of time."""
    f = in_cells(faults.select(F.col("component_id").alias("_c"), "fault_id", "onset", "failure"), F.col("onset") - horizon_us, F.col("failure"), cell)
    e = in_cells(episodes, F.col("t_start"), F.col("t_end"), cell).withColumnRenamed("_cell", "_at")
    hit = e.join(f, (F.col("component_id") == F.col("_c")) & (F.col("_at") == F.col("_cell")) & (F.col("t_start") <= F.col("failure")) & (F.col("t_end") >= F.col("onset") - horizon_us))
    first = hit.groupBy("component_id", "episode").agg(F.min(F.struct("fault_id", "onset", "failure")).alias("f"))
    return episodes.join(first, ["component_id", "episode"], "left").select(
        *episodes.columns, F.col("f.fault_id").alias("fault_id"), F.col("f").isNotNull().alias("matched"), ((F.col("f.failure") - F.col("t_start")) / 3.6e9).alias("lead_h")
    )


def faults_detected(faults: DataFrame, episodes: DataFrame, horizon_us: int) -> DataFrame:
    """Adds detected: whether any episode overlaps the fault's detection window."""
    x = reached(faults, episodes.select("component_id", "t_start", "t_end"), ["component_id"], F.col("failure"), F.col("t_start"), F.col("t_end"))
    return x.withColumn("detected", F.coalesce(F.col("_reach") >= F.col("onset") - horizon_us, F.lit(False))).drop("_reach")


def nearest_event_distance(rows: DataFrame, events: DataFrame, keys: list[str], time: str, event_time: str) -> DataFrame:
    """Adds distance to the nearest event on either side, by one union and running last and first."""
    e = events.select(*keys, F.col(event_time).alias("_t"), F.col(event_time).alias("_e"), F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType).alias("_row"))
    r = rows.select(*keys, F.col(time).alias("_t"), F.lit(None).cast("long").alias("_e"), F.struct("*").alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_t")
    u = e.unionByName(r).withColumn("_b", F.last("_e", True).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_a", F.first("_e", True).over(w.rangeBetween(0, Window.unboundedFollowing)))
    return u.where("_row is not null").select("_row.*", F.least(F.col("_t") - F.col("_b"), F.col("_a") - F.col("_t")).alias("distance"))


def blank_post_failure(rows: DataFrame, faults: DataFrame, hold_us: int) -> DataFrame:
    """Rows outside of (failure, failure + hold] of every fault of their component."""
    x = reached(rows, faults.select("component_id", "failure"), ["component_id"], F.col("t"), F.col("failure") + 1, F.col("failure") + hold_us)
    return x.where(~F.coalesce(F.col("_reach") >= F.col("t"), F.lit(False))).select(*rows.columns)


def overlay_patch(rows: DataFrame, patch: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Replaces each patched series from its first corrected time on."""
    cut = patch.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(time).alias("_cut"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(time) >= F.col("_cut")]
    return rows.join(cut, on, "left_anti").unionByName(patch)
