"""Queries as of a time T over scores and episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axlewatch.operators.joins import asof_backward


def component_state_at(scores: DataFrame, episodes: DataFrame, at: int, threshold: float, stale_us: int, warn: float = 0.8) -> DataFrame:
    """component_id, score, state: the latest score by T; stale scores are ok, an open episode is crit, above warn * threshold is warn."""
    last = scores.where(F.col("t") <= at).groupBy("component_id").agg(F.max("t").alias("t"), F.max_by("score", "t").alias("score"))
    open_now = episodes.where((F.col("t_start") <= at) & (F.col("t_end") >= at)).select(F.col("component_id").alias("_c")).distinct()
    state = F.when(F.lit(at) - F.col("t") > stale_us, "ok").when(F.col("_c").isNotNull(), "crit").when(F.col("score") > warn * threshold, "warn").otherwise("ok")
    return last.join(open_now, F.col("component_id") == F.col("_c"), "left").select("component_id", "t", "score", state.alias("state"))


def alerts_at(episodes: DataFrame, scores: DataFrame, at: int, limit: int = 25) -> DataFrame:
    """Episodes begun by T, newest first; the peak is that of rows by T and the end is NULL while open."""
    e = episodes.where(F.col("t_start") <= at)
    rows = scores.where(F.col("t") <= at).select("component_id", F.col("t").alias("_t"), "score")
    j = asof_backward(rows, e, ["component_id"], "_t", "t_start", ["episode", "t_start", "t_end"]).where(F.col("_t") <= F.col("t_end"))
    g = j.groupBy("component_id", "episode", "t_start", "t_end").agg(F.max("score").alias("peak"))
    return g.orderBy(F.col("t_start").desc(), "component_id").limit(limit).select("component_id", "episode", "t_start", F.when(F.col("t_end") <= at, F.col("t_end")).alias("t_end"), "peak")


def transitions(episodes: DataFrame) -> DataFrame:
    return episodes.select("component_id", "episode", F.explode(F.array(F.struct(F.col("t_start").alias("t"), F.lit("open").alias("what")), F.struct(F.col("t_end").alias("t"), F.lit("close").alias("what")))).alias("x")).select("component_id", "episode", "x.*")


def ticker_at(episodes: DataFrame, at: int, n: int = 20) -> DataFrame:
    """The last n openings and closings by T."""
    return transitions(episodes).where(F.col("t") <= at).orderBy(F.col("t").desc(), "component_id", "what").limit(n)


def series_minmax(df: DataFrame, keys: list[str], time: str, value: str, max_points: int) -> DataFrame:
    """A series of at most max_points rows whole; else, of each of max_points / 2 buckets of equal count, the first least and the first greatest finite value, or its first row if none is finite."""
    w, buckets = Window.partitionBy(*keys), max(max_points // 2, 1)
    p = df.select(*keys, F.col(time).alias("t"), F.col(value).cast("double").alias("value"), (F.row_number().over(w.orderBy(time)) - 1).alias("_p"), F.count(F.lit(1)).over(w).alias("_n"))
    p = p.withColumn("_b", F.when(F.col("_n") <= max_points, F.col("_p")).otherwise(F.floor(F.col("_p") * buckets / F.col("_n"))))
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    low = F.min(F.when(finite, F.struct(F.col("value").alias("v"), "t")))
    high = F.min(F.when(finite, F.struct((-F.col("value")).alias("v"), "t")))
    g = p.groupBy(*keys, "_b").agg(low.alias("a"), high.alias("z"), F.min(F.struct("t", "value")).alias("first"))
    both = F.array_distinct(F.array(F.struct(F.col("a.t").alias("t"), F.col("a.v").alias("v")), F.struct(F.col("z.t").alias("t"), (-F.col("z.v")).alias("v"))))
    none = F.array(F.struct(F.col("first.t").alias("t"), F.col("first.value").alias("v")))
    return g.select(*keys, F.explode(F.when(F.col("a").isNull(), none).otherwise(both)).alias("x")).select(*keys, F.col("x.t").alias("t"), F.col("x.v").alias("value"))


def recent_events(events: DataFrame, at: int, n: int, key: str) -> DataFrame:
    """The last n events of each component by T."""
    w = Window.partitionBy(key).orderBy(F.col("t").desc(), F.col("event_id").desc())
    return events.where(F.col("t") <= at).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def nearest_cycle(df: DataFrame, keys: list[str], time: str, at: int, gap: int, reaches: tuple[int, ...]) -> DataFrame:
    """keys, t_start, t_end, n of the stretch (steps up to gap) whose midpoint is nearest to `at`; the first on a tie.

    The least of the given reaches that holds any row is searched; a stretch that runs up to its border counts only if no
    whole one is there. A series without rows in the widest reach gives none.
    """
    far = F.abs(F.col(time) - at)
    x = df.where(far <= reaches[-1])
    least = x.groupBy(*keys).agg(F.min(far).alias("_f")).select(*keys, F.coalesce(*[F.when(F.col("_f") <= r, F.lit(r)) for r in reaches]).alias("_reach"))
    w = Window.partitionBy(*keys).orderBy(time)
    x = x.join(least, keys).where(far <= F.col("_reach")).withColumn("_new", (F.coalesce(F.col(time) - F.lag(time).over(w), F.lit(gap + 1)) > gap).cast("int"))
    s = x.withColumn("_s", F.sum("_new").over(w)).groupBy(*keys, "_s").agg(F.min(time).alias("t_start"), F.max(time).alias("t_end"), F.count(F.lit(1)).alias("n"), F.first("_reach").alias("_reach"))
    cut = (F.col("t_start") - (at - F.col("_reach")) < gap) | (at + F.col("_reach") - F.col("t_end") < gap)
    best = Window.partitionBy(*keys).orderBy(cut, F.abs(F.floor((F.col("t_start") + F.col("t_end")) / 2) - at), "t_start")
    return s.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*keys, "t_start", "t_end", "n")


def alert_context(episodes: DataFrame, scores: DataFrame, keys: list[str], name: str, limit: int = 12) -> DataFrame:
    """A row per episode(keys, name, t_start, t_end): its length in hours, the last score in it, its peak, and the last `limit` event ids, newest first. scores: keys, t, event_id, score.

    Episodes of a series don't overlap, so each score row finds its own by one running last, not by a range join.
    """
    e = episodes.select(*keys, "t_start", F.struct(name, F.col("t_start").alias("a"), F.col("t_end").alias("b")).alias("_e"))
    inside = asof_backward(scores, e, keys, "t", "t_start", ["_e"]).where(F.col("t") <= F.col("_e.b")).select("*", "_e.*")
    w = Window.partitionBy(*keys, name).orderBy(F.col("t").desc(), F.col("event_id").desc())
    last = inside.withColumn("_r", F.row_number().over(w)).groupBy(*keys, name).agg(
        F.max("score").alias("peak"), F.max(F.when(F.col("_r") == 1, F.col("score"))).alias("score"), F.array_sort(F.collect_list(F.when(F.col("_r") <= limit, F.struct("_r", "event_id")))).alias("_l"),
    )
    out = episodes.select(*keys, name, ((F.col("t_end") - F.col("t_start")) / 3.6e9).alias("hours"))
    return out.join(last, [*keys, name], "left").select(*keys, name, "hours", "score", "peak", F.coalesce(F.transform("_l", lambda x: x["event_id"]), F.array().cast("array<long>")).alias("events"))
