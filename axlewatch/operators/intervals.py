"""One-to-one matching of intervals by how much they overlap, and its score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlaps(truth: DataFrame, found: DataFrame, keys: list[str], cell: int) -> DataFrame:
    """keys, true_id, found_id, iou > 0 of intervals(keys, id, a, b) of equal keys (stream and label among them).

    Intervals meet in cells of time of this width, which should be about their length; a pair counts in the first cell
    that both touch, so it comes out once and a long series is spread over its cells.
    """

    def dealt(d: DataFrame, name: str, a: str, b: str) -> DataFrame:
        x = d.where("a <= b").select(*keys, F.col("id").alias(name), F.col("a").alias(a), F.col("b").alias(b))
        return x.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))))

    j = dealt(truth, "true_id", "_ta", "_tb").join(dealt(found, "found_id", "_fa", "_fb"), [*keys, "_cell"])
    inter = F.least("_tb", "_fb") - F.greatest("_ta", "_fa")
    union = F.col("_tb") - F.col("_ta") + F.col("_fb") - F.col("_fa") - inter
    once = F.col("_cell") == F.floor(F.greatest("_ta", "_fa") / cell)
    return j.where(once & (inter > 0)).select(*keys, "true_id", "found_id", (inter / union).alias("iou"))


def iou_match(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs that are taken when they are gone through by falling iou, then true_id and found_id, each interval being used once.

    A pair that is the first of both its intervals is taken whatever the rest, so all such pairs are taken at once, and those that
    share an interval with them leave; rounds go on until no pair is left. Only a count per round comes to the driver.
    """
    order = [F.col("iou").desc(), F.col("true_id"), F.col("found_id")]
    left, taken = pairs.select(*keys, "true_id", "found_id", "iou").checkpoint(), []
    while not left.isEmpty():
        first = [F.row_number().over(Window.partitionBy(*keys, side).orderBy(*order)) for side in ("true_id", "found_id")]
        best = left.withColumn("_a", first[0]).withColumn("_b", first[1]).where("_a = 1 and _b = 1").drop("_a", "_b").checkpoint()
        taken.append(best)
        for side in ("true_id", "found_id"):
            left = left.join(best.select(*keys, side), [*keys, side], "left_anti")
        left = left.checkpoint()
    out = left
    for best in taken:
        out = out.unionByName(best)
    return out.select(*keys, "true_id", "found_id", "iou")


def iou_f1(truth: DataFrame, found: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: soft_recall, soft_precision (summed iou by number of intervals) and their harmonic mean, 0 where there is nothing."""
    n = truth.agg(F.count(F.lit(1)).alias("n")).join(found.agg(F.count(F.lit(1)).alias("m"))).join(matches.agg(F.coalesce(F.sum("iou"), F.lit(0.0)).alias("s")))  # one row each
    r, p = (F.coalesce(F.col("s") / F.nullif(F.col(c), F.lit(0)), F.lit(0.0)) for c in ("n", "m"))
    return n.select(r.alias("soft_recall"), p.alias("soft_precision"), F.coalesce(2 * r * p / F.nullif(r + p, F.lit(0.0)), F.lit(0.0)).alias("score"))
