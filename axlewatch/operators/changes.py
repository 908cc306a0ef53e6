"""Scores of change points against true ones. A change point is the place where a new segment begins."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def covering(sizes: DataFrame, truth: DataFrame, guess: DataFrame, keys: list[str], n: str, at: str) -> DataFrame:
    """keys, covering: the mean over readings of the best Jaccard index of their true segment with a guessed one.

    sizes has a row per series with its length n. Points outside 1 to n - 1 and repeated points don't count; a series without
    readings is NULL. The cuts of both sides split a series into pieces, each in one segment of either side, so pieces are summed
    instead of segments joined.
    """

    def cuts(points: DataFrame, side: str) -> DataFrame:
        return points.select(*keys, F.col(at).cast("long").alias("_at")).distinct().withColumn("_side", F.lit(side))

    start = sizes.where(F.col(n) > 0).select(*keys, F.lit(0).cast("long").alias("_at"), F.explode(F.array(F.lit("t"), F.lit("g"))).alias("_side"))
    inside = cuts(truth, "t").unionByName(cuts(guess, "g")).join(sizes.select(*keys, n), keys).where(F.col("_at").between(1, F.col(n) - 1)).drop(n)
    places = inside.unionByName(start).groupBy(*keys, "_at").agg(F.max(F.when(F.col("_side") == "t", F.col("_at"))).alias("_t"), F.max(F.when(F.col("_side") == "g", F.col("_at"))).alias("_g"))
    w = Window.partitionBy(*keys).orderBy("_at")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    pieces = places.join(sizes.select(*keys, n), keys).select(*keys, n, F.last("_t", True).over(up).alias("_t"), F.last("_g", True).over(up).alias("_g"), (F.coalesce(F.lead("_at").over(w), F.col(n)) - F.col("_at")).alias("_both"))
    a, b = (F.sum("_both").over(Window.partitionBy(*keys, c)) for c in ("_t", "_g"))
    met = pieces.select(*keys, n, "_t", a.alias("_a"), "_g", b.alias("_b"), "_both").groupBy(*keys, n, "_t", "_a", "_g", "_b").agg(F.sum("_both").alias("_both"))
    best = met.groupBy(*keys, n, "_t", "_a").agg(F.max(F.col("_both") / (F.col("_a") + F.col("_b") - F.col("_both"))).alias("_j"))
    return sizes.select(*keys).join(best.groupBy(*keys).agg((F.sum(F.col("_a") * F.col("_j")) / F.first(n)).alias("covering")), keys, "left")


def matched(truth: DataFrame, guess: DataFrame, keys: list[str], at: str, margins: list[int]) -> DataFrame:
    """keys, margin, at, hit for each true point: does it get a guess within the margin? In order of place, each true point takes the nearest
    guess that is left (the smaller of two as near).

    Points stream in order through the task of their series and margin, which holds the guesses of two margins' length only.
    """
    keyed = [truth.schema[k] for k in keys]
    schema = T.StructType([*keyed, T.StructField("margin", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("hit", T.BooleanType())])
    width = len(keys)

    def points(df: DataFrame, true: bool) -> DataFrame:
        p = df.select(*keys, F.col(at).cast("long").alias("_at")).distinct().withColumn("_m", F.explode(F.array(*[F.lit(m) for m in margins])))
        return p.select(*keys, "_m", (F.col("_at") + (F.col("_m") if true else F.lit(0))).alias("_due"), F.lit(true).alias("_true"), "_at")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left = None, deque()
        for batch in batches:
            out = []
            for *key, m, _, true, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if [*key, m] != now:
                    now, left = [*key, m], deque()
                while left and left[0] < x - (m if true else 2 * m):
                    left.popleft()
                if not true:
                    left.append(x)
                    continue
                near = min(left, key=lambda g: (abs(g - x), g), default=None)
                if near is not None:
                    left.remove(near)
                out.append((*key, m, x, near is not None))
            columns = list(zip(*out, strict=True)) if out else [[]] * (width + 3)
            types = [*[batch.schema.field(i).type for i in range(width)], pa.int32(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    both = points(truth, True).unionByName(points(guess, False))
    # a guess comes before the true point that falls due at its place
    return both.repartition(*keys, "_m").sortWithinPartitions(*keys, "_m", "_due", "_true", "_at").mapInArrow(each, schema)


def f1_by_margin(truth: DataFrame, guess: DataFrame, keys: list[str], at: str, margins: list[int]) -> DataFrame:
    """keys, margin, precision, recall, f1 of each series with a true point; 0 without guesses."""
    hits = matched(truth, guess, keys, at, margins).groupBy(*keys, "margin").agg(F.count(F.lit(1)).alias("_t"), F.sum(F.col("hit").cast("long")).alias("_h"))
    guesses = guess.select(*keys, F.col(at).cast("long").alias("_at")).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_g"))
    share: dict[str, Column] = {"precision": F.coalesce(F.col("_h") / F.col("_g"), F.lit(0.0)), "recall": F.col("_h") / F.col("_t")}
    p, r = F.col("precision"), F.col("recall")
    return hits.join(guesses, keys, "left").withColumns(share).select(*keys, "margin", "precision", "recall", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"))


def cpd_metrics(sizes: DataFrame, truth: DataFrame, guess: DataFrame, keys: list[str], n: str, at: str, margin: int = 5) -> DataFrame:
    """keys, covering, f1 at the margin, mean_f1 over margins of 1 to twice the margin, n_true, n_guess. F1 is NULL without true points."""
    f = f1_by_margin(truth, guess, keys, at, list(range(1, 2 * margin + 1))).groupBy(*keys).agg(F.max(F.when(F.col("margin") == margin, F.col("f1"))).alias("f1"), F.avg("f1").alias("mean_f1"))
    out = covering(sizes, truth, guess, keys, n, at).join(f, keys, "left")
    for name, side in (("n_true", truth), ("n_guess", guess)):
        counts = side.groupBy(*keys).agg(F.count_distinct(at).alias(name))
        out = out.join(counts, keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out
