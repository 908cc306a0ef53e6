"""Thresholds, alarm episodes and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axlewatch.operators.joins import asof_backward
from axlewatch.operators.ranked import dealt, order_statistics, running_sums


def quantile_thresholds(scores: DataFrame, score: str, qs: list[float], keys: list[str] = []) -> DataFrame:  # noqa: B006
    return order_statistics(scores, score, {f"q{str(q)[2:]}": q for q in qs}, keys)


def row_pitch(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """One row: the median positive step inside series."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    return df.select((F.col(time) - F.lag(time).over(w)).alias("step")).where("step > 0").transform(order_statistics, "step", {"pitch": 0.5})


def alarm_spans(scores: DataFrame, keys: list[str], time: str, tie: str, over: Column, score: str, k: int, merge_gap: int, max_step: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their position _p and all columns as _row, spans: keys, episode, t_start, t_end, first and last position)."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    x = scores.select(*keys, F.struct("*").alias("_row"), F.col(time).alias("_t"), F.col(score).alias("_s"), F.coalesce(over, F.lit(False)).alias("_o"), F.row_number().over(w).alias("_p"), (F.col(time) - F.lag(time).over(w)).alias("_d"))
    by_p = Window.partitionBy(*keys).orderBy("_p")
    start = F.col("_o") & (~F.coalesce(F.lag("_o").over(by_p), F.lit(False)) | F.coalesce(F.col("_d") > max_step, F.lit(False)))
    x = x.withColumn("_run", F.sum(start.cast("int")).over(by_p.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.where("_o").groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("n"), F.min("_t").alias("a"), F.max("_t").alias("b"), F.min("_p").alias("pa"), F.max("_p").alias("pb")).where(F.col("n") >= k)
    by_run = Window.partitionBy(*keys).orderBy("_run")
    new = F.coalesce(F.col("a") - F.lag("b").over(by_run) >= merge_gap, F.lit(True))
    runs = runs.withColumn("_new", new.cast("int")).withColumn("episode", F.sum("_new").over(by_run.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return x, runs.groupBy(*keys, "episode").agg(F.min("a").alias("t_start"), F.max("b").alias("t_end"), F.min("pa").alias("pa"), F.max("pb").alias("pb"))


def episodes(scores: DataFrame, keys: list[str], time: str, tie: str, over: Column, score: str, k: int, merge_gap: int, max_step: int) -> DataFrame:
    """Runs of rows over the threshold, cut where a step exceeds max_step; runs of at least k rows stay and are then merged
    if the next begins less than merge_gap after the last end. n_rows and peak cover every row of the span.

    keys, episode (from 0), t_start, t_end, n_rows, peak. Windows by series only; spans join back by position.
    """
    x, spans = alarm_spans(scores, keys, time, tie, over, score, k, merge_gap, max_step)
    inside = asof_backward(x.drop("_row"), spans, keys, "_p", "pa", ["episode", "t_start", "t_end", "pb"]).where("_p <= pb")  # spans of a series don't overlap
    return inside.groupBy(*keys, "episode", "t_start", "t_end").agg(F.count(F.lit(1)).alias("n_rows"), F.max("_s").alias("peak"))


def alert_flags(scores: DataFrame, keys: list[str], time: str, tie: str, over: Column, score: str, k: int, merge_gap: int, max_step: int) -> DataFrame:
    """Adds alert: whether a row lies in an episode, by position, so rows that tie with an episode's border aren't drawn in."""
    x, spans = alarm_spans(scores, keys, time, tie, over, score, k, merge_gap, max_step)
    near = asof_backward(x, spans.where(F.col("pa").isNotNull()), keys, "_p", "pa", ["pb"])
    return near.select("_row.*", F.coalesce(F.col("_p") <= F.col("pb"), F.lit(False)).alias("alert"))


def calibrate_budget(scores: DataFrame, keys: list[str], time: str, tie: str, score: str, k: int, merge_gap: int, max_step: int, per_day: float = 1 / 7, steps: int = 128) -> DataFrame:
    """step, threshold, n_episodes, over_budget, usable, for thresholds from the median to the maximum; usable are those above the last violation.

    Positions and cuts are found once; a row is then repeated for the thresholds it exceeds only, and runs are the positions
    that follow each other.
    """
    lim = order_statistics(scores, score, {"lo": 0.5}).join(scores.agg(F.max(score).alias("hi")))  # one row each
    grid = lim.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (steps - 1))).alias("step", "thr"))
    all_thr = grid.agg(F.array_sort(F.collect_list("thr")).alias("_thr"))  # one row of `steps` thresholds
    w = Window.partitionBy(*keys).orderBy(time, tie)
    x = scores.select(*keys, F.col(time).alias("_t"), F.col(score).alias("_s"), F.row_number().over(w).alias("_p"), F.coalesce(F.col(time) - F.lag(time).over(w) > max_step, F.lit(False)).cast("int").alias("_cut"))
    x = x.withColumn("_seg", F.sum("_cut").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)))
    above = x.join(F.broadcast(all_thr)).select(*keys, "_t", "_p", "_seg", F.posexplode(F.filter("_thr", lambda t: F.col("_s") > t)).alias("step", "_x"))
    isle = F.col("_p") - F.row_number().over(Window.partitionBy(*keys, "step").orderBy("_p"))
    runs = above.withColumn("_isle", isle).groupBy(*keys, "step", "_seg", "_isle").agg(F.count(F.lit(1)).alias("n"), F.min("_t").alias("a"), F.max("_t").alias("b"), F.min("_p").alias("pa")).where(F.col("n") >= k)
    new = F.coalesce(F.col("a") - F.lag("b").over(Window.partitionBy(*keys, "step").orderBy("pa")) >= merge_gap, F.lit(True))
    found = runs.withColumn("new", new.cast("long")).groupBy("step").agg(F.sum("new").alias("n"))
    per = grid.join(found, "step", "left").withColumn("n_episodes", F.coalesce("n", F.lit(0))).join(train_days(scores, keys, time))
    per = per.withColumn("over_budget", F.col("n_episodes") > F.col("train_days") * per_day)
    worst = F.max(F.when(F.col("over_budget"), F.col("step"))).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # a row per step
    return per.select("step", F.col("thr").alias("threshold"), "n_episodes", "over_budget", (F.col("step") > F.coalesce(worst, F.lit(-1))).alias("usable"))


def episodes_from_scores(scores: DataFrame, unit: str, key: str, time: str, tie: str, score: str, threshold: str, k: int, merge_gap: int, max_step: int) -> DataFrame:
    """Episodes by the threshold that each row carries, with episode_id unit-key-n; n counts per (unit, key)."""
    ep = episodes(scores, [unit, key], time, tie, F.col(score) > F.col(threshold), score, k, merge_gap, max_step)
    return ep.withColumn("episode_id", F.concat_ws("-", F.col(unit), F.col(key), F.col("episode")))


def train_days(df: DataFrame, unit: list[str], time: str) -> DataFrame:
    return df.groupBy(*unit).agg(((F.max(time) - F.min(time)) / 8.64e10).alias("d")).agg(F.sum("d").alias("train_days"))


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: area under the ROC curve by mid-ranks over distinct scores; NULL with one class."""
    g = df.groupBy(score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    x = running_sums(g, [score], {"upto": F.col("n")})
    return x.agg((F.sum(F.col("p") * (F.col("upto") - F.col("n") / 2)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auroc"))


def auprc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: step-wise average precision over distinct scores."""
    g = df.groupBy((-F.col(score)).alias("_down")).agg(F.sum(label).alias("p"), F.count(F.lit(1)).alias("c"))
    x = running_sums(g, ["_down"], {"hits": F.col("p"), "rows": F.col("c")})
    return x.agg((F.sum(F.col("p") * F.col("hits") / F.col("rows")) / F.nullif(F.sum("p"), F.lit(0))).alias("auprc"))


def cls_metrics(df: DataFrame, truth: str, guess: str, labels: list[str]) -> DataFrame:
    """A row per label: tp, fp, fn, precision, recall, f1 (0 where undefined), and macro_f1 and balanced_accuracy (over labels that occur) of all labels."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("n"))  # confusion first; the vocabulary meets it, not the rows
    cells = cells.withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels])))
    t, g = F.col("t") == F.col("label"), F.col("g") == F.col("label")
    hit = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    c = cells.groupBy("label").agg(hit(t & g).alias("tp"), hit(F.coalesce(~t, F.lit(True)) & g).alias("fp"), hit(t & F.coalesce(~g, F.lit(True))).alias("fn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    c = c.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row per label
    return c.withColumn("macro_f1", F.avg("f1").over(every)).withColumn("balanced_accuracy", F.avg(F.when(tp + fn > 0, F.col("recall"))).over(every))


def monotonicity(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Spearman's correlation with average ranks per key; NULL below 3 rows or if a side is constant."""

    def rank(c: str) -> Column:  # one sort: equal values are a frame of the same order
        w = Window.partitionBy(*keys).orderBy(c)
        return F.rank().over(w) + (F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2

    r = dealt(df, keys).select(*keys, rank(x).alias("rx"), rank(y).alias("ry"))
    g = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"), F.covar_pop("rx", "ry").alias("c"))
    return g.select(*keys, F.when((F.col("n") >= 3) & (F.col("sx") > 0) & (F.col("sy") > 0), F.col("c") / (F.col("sx") * F.col("sy"))).alias("rho"))


def ks_two_sample(df: DataFrame, value: str, first: Column) -> DataFrame:
    """One row: the largest gap between two empirical distributions, over distinct values."""
    g = df.groupBy(value).agg(F.sum(first.cast("long")).alias("a"), F.sum((~first).cast("long")).alias("b"))
    x = running_sums(g, [value], {"sa": F.col("a"), "sb": F.col("b")})
    total = x.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return x.join(F.broadcast(total)).agg(F.max(F.abs(F.col("sa") / F.col("na") - F.col("sb") / F.col("nb"))).alias("ks"))  # one row of totals
