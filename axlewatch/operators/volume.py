"""Volume under the surface of range-aware precision and recall: a score judged against stretches of anomaly with soft borders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axlewatch.operators.ranked import running_sums


def stretches(rows: DataFrame) -> DataFrame:
    """rows(p, y), p without gaps -> the rows of y with i, the number of their stretch from 1."""
    y = rows.where("y")
    ahead = y.select((F.col("p") + 1).alias("p"), F.lit(True).alias("_goes_on"))
    return running_sums(y.join(ahead, "p", "left"), ["p"], {"i": F.when(F.col("_goes_on"), 0).otherwise(1)}).drop("_goes_on")


def vus_pr(df: DataFrame, order: list[str], score: str, label: str, buffer: int, thresholds: int = 250) -> DataFrame:
    """One row: vus_pr, the mean over buffers 0 to `buffer` of the area under range precision and recall; NULL without both classes.

    `order` puts each row at one place. Rows of NULL or NaN scores or NULL labels are left out. A threshold is a score at
    equal steps of rank. Only rows within half a buffer of a stretch carry a soft weight, so what is repeated for each
    buffer is the surroundings of stretches, not the table; all that is summed over thresholds is (buffer, threshold).
    """
    x = df.select(*order, F.col(score).cast("double").alias("score"), F.col(label).cast("boolean").alias("y")).where("score is not null and not isnan(score) and y is not null")
    rows = running_sums(x, order, {"p": F.lit(1)}).select("p", "score", "y").checkpoint()
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("pos")).withColumn("steps", F.least(F.lit(thresholds), F.greatest(F.col("n"), F.lit(2))) - 1)  # one row
    counts = rows.groupBy("score").agg(F.count(F.lit(1)).alias("c")).withColumn("_o", -F.col("score"))
    above = running_sums(counts, ["_o"], {"l": F.col("c")}).join(F.broadcast(total))
    first = F.ceil((F.col("l") - F.col("c")) * F.col("steps") / F.greatest(F.col("n") - 1, F.lit(1)))  # the first threshold that the score reaches
    placed = rows.join(above.select("score", first.cast("int").alias("k")), "score").checkpoint()

    hits = placed.groupBy("k").agg(F.count(F.lit(1)).alias("pred"), F.sum(F.col("y").cast("long")).alias("hit"))
    own = stretches(placed)
    seg = own.groupBy("i").agg(F.min("p").alias("s"), F.max("p").alias("e"), F.min("k").alias("k")).checkpoint()

    half, ws = buffer // 2, F.sequence(F.lit(0), F.lit(buffer))
    empty = F.array().cast("array<int>")
    steps = F.explode(F.sequence(F.lit(1), F.lit(half)) if half else empty).alias("d")
    sides = seg.select("i", "s", "e", steps).select("i", "d", F.explode(F.array(F.col("s") - F.col("d"), F.col("e") + F.col("d"))).alias("p"))
    near = sides.join(placed.where("not y").select("p", "k"), "p").select("i", "d", "p", "k", F.explode(F.sequence(2 * F.col("d"), F.lit(buffer))).alias("w"))
    soft = near.groupBy("w", "p", "k").agg(F.least(F.lit(1.0), F.sum(F.sqrt(1 - F.col("d") / F.col("w")))).alias("x")).groupBy("w", "k").agg(F.sum("x").alias("x"))

    # stretches whose borders touch are one; it exists from the first threshold that one of its rows reaches
    last = seg.select((F.col("i") + 1).alias("i"), F.col("e").alias("_e"))
    each = seg.join(last, "i", "left").select("i", "s", "_e", F.explode(ws).alias("w"))
    apart = F.when(F.col("_e") + F.floor(F.col("w") / 2) >= F.col("s") - F.floor(F.col("w") / 2), 0).otherwise(1)
    merged = running_sums(each, ["i"], {"m": apart}, ["w"]).select("w", "i", "m")
    seen = seg.select("i", "k", F.explode(ws).alias("w")).unionByName(near.select("i", "k", "w")).groupBy("w", "i").agg(F.min("k").alias("k"))
    begin = merged.join(seen, ["w", "i"]).groupBy("w", "m").agg(F.min("k").alias("k")).groupBy("w", "k").agg(F.count(F.lit(1)).alias("found"))

    grid = total.where("pos > 0 and pos < n").select("pos", F.explode(ws).alias("w"), "steps").select("pos", "w", F.explode(F.sequence(F.lit(0), F.col("steps").cast("int"))).alias("k"))
    g = grid.join(hits, "k", "left").join(soft, ["w", "k"], "left").join(begin, ["w", "k"], "left").fillna(0, ["pred", "hit", "x", "found"])
    up = Window.partitionBy("w").orderBy("k")  # a row for each threshold
    g = g.select("w", "k", "pos", *[F.sum(c).over(up).alias(c) for c in ("pred", "hit", "x", "found")], F.sum("found").over(Window.partitionBy("w")).alias("all"))
    true = F.col("hit") + F.col("x")
    recall = F.least(true / (F.col("pos") + F.col("x") / 2), F.lit(1.0)) * F.col("found") / F.col("all")
    c = g.select("w", "k", recall.alias("r"), F.when(F.col("pred") > 0, true / F.col("pred")).otherwise(F.lit(1.0)).alias("q"))
    c = c.withColumn("_a", (F.col("r") - F.coalesce(F.lag("r").over(up), F.lit(0.0))) * F.col("q"))
    return c.groupBy("w").agg(F.sum("_a").alias("a")).agg(F.avg("a").alias("vus_pr"))
