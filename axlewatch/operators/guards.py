"""Which rows a model may learn from or be judged on, and labels of stretches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axlewatch.operators.joins import in_cells, reached
from axlewatch.operators.ranked import running_sums


def events_in_slice(faults: DataFrame, rows: DataFrame, key: str, time: str, horizon: int) -> DataFrame:
    """Faults whose detection window [onset - horizon, failure] touches the span of their series in the slice."""
    span = rows.groupBy(F.col(key).alias("_k")).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    return faults.join(span, (F.col(key) == F.col("_k")) & (F.col("onset") - horizon <= F.col("_b")) & (F.col("failure") >= F.col("_a")), "left_semi")


def label_segments(segments: DataFrame, truth: DataFrame, key: str, id_: list[str], label: str, least: float = 0.1, cell: int = 2 * 86_400_000_000) -> DataFrame:
    """Adds label and iou of the truth interval (onset, failure, label) of the same key that a segment (t_start, t_end) shares most with, if it is `least` or more; the first label on a tie. Both meet in cells of time."""
    t = in_cells(truth.select(F.col(key).alias("_k"), F.col("onset").alias("_a"), F.col("failure").alias("_b"), F.col(label).alias("_l")), F.col("_a"), F.col("_b"), cell)
    s = in_cells(segments.select(*segments.columns), F.col("t_start"), F.col("t_end"), cell).withColumnRenamed("_cell", "_at")
    j = s.join(t, (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_cell")) & (F.col("t_start") <= F.col("_b")) & (F.col("t_end") >= F.col("_a")))
    shared = F.least("t_end", "_b") - F.greatest("t_start", "_a")
    j = j.withColumn("_iou", shared / F.nullif(F.greatest("t_end", "_b") - F.least("t_start", "_a"), F.lit(0))).where(F.col("_iou") >= least)
    best = j.groupBy(*[F.col(c).alias(f"_{c}") for c in id_]).agg(F.max_by(F.struct("_l", "_iou"), F.struct("_iou", -F.col("_l"))).alias("_x"))
    return segments.join(best, [F.col(c) == F.col(f"_{c}") for c in id_], "left").select(*segments.columns, F.col("_x._l").alias("label"), F.col("_x._iou").alias("iou"))


def normal_window_guard(rows: DataFrame, faults: DataFrame, key: str, time: str, start: int, end: int, guard: int) -> DataFrame:
    """Rows of [start, end) further than the guard from every failure of their series."""
    inside = rows.where((F.col(time) >= start) & (F.col(time) < end))
    x = reached(inside, faults.select(key, "failure"), [key], F.col(time), F.col("failure") - guard, F.col("failure") + guard)
    return x.where(~F.coalesce(F.col("_reach") >= F.col(time), F.lit(False))).select(*rows.columns)


def extend_labels_to_end(rows: DataFrame, faults: DataFrame, key: str, time: str) -> DataFrame:
    """Adds is_faulty: from the first onset of its series on, to the end; nothing is repaired."""
    first = faults.groupBy(F.col(key).alias("_k")).agg(F.min("onset").alias("_on"))
    return rows.join(first, F.col(key) == F.col("_k"), "left").withColumn("is_faulty", F.coalesce(F.col(time) >= F.col("_on"), F.lit(False))).drop("_k", "_on")


def carve_rows(df: DataFrame, series: str, row_id: str, share: float) -> DataFrame:
    """Adds part: the first `share` of series (rounded up) by a hash of their name to val, else train; rows instead, if there is one series only."""
    names = df.select(F.col(series).alias("_s")).distinct()
    n = names.count()
    if n > 1:
        ranked = running_sums(names.withColumn("_h", F.md5(F.col("_s").cast("string"))), ["_h", "_s"], {"_r": F.lit(1)})
        part = F.when(F.col("_r") <= F.ceil(F.lit(n * share)), "val").otherwise("train")
        return df.join(ranked.select("_s", part.alias("part")), F.col(series).eqNullSafe(F.col("_s"))).drop("_s")
    bits = F.conv(F.substring(F.md5(F.col(row_id).cast("string")), 1, 8), 16, 10).cast("long")
    return df.withColumn("part", F.when(bits < F.lit(int(share * (1 << 32))), "val").otherwise("train"))


def train_rows(df: DataFrame, faulty: str, row_id: str, contamination: float = 0.0, finite: str | None = None) -> DataFrame:
    """Normal rows, and of the faulty ones, in the order of a hash of their id, as many as `contamination` times the normal ones; with a finite target only, if one is named."""
    if finite:
        df = df.where(F.col(finite).isNotNull() & ~F.isnan(finite))
    normal = df.where(~F.col(faulty))
    most = int(normal.count() * contamination)
    return normal.unionByName(df.where(F.col(faulty)).orderBy(F.md5(F.col(row_id).cast("string")), row_id).limit(most))


def peer_split_guard(df: DataFrame, group: list[str], held: str) -> DataFrame:
    """Peer groups that a held-out key would cut: group and how many of its values they have, where that isn't one."""
    return df.groupBy(*group).agg(F.countDistinct(held).alias("n")).where("n <> 1")


def alarm_window_rows(rows: DataFrame, faults: DataFrame, key: str, time: str, horizon: int) -> DataFrame:
    """One row: rows, and how many of them lie in any detection window of their series."""
    x = reached(rows, faults.select(key, "onset", "failure"), [key], F.col(time), F.col("onset") - horizon, F.col("failure"))
    inside = x.agg(F.count(F.when(F.col("_reach") >= F.col(time), 1)).alias("inside"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).join(inside)  # one row each


def mirror_rows(df: DataFrame, pairs: list[tuple[str, str]], label: str, swap: dict[str, str]) -> DataFrame:
    """Rows, and their mirror images: each pair of side columns changes places, and labels are swapped. Adds mirrored."""
    other = {a: b for x, y in pairs for a, b in ((x, y), (y, x))}
    names = F.create_map(*[F.lit(x) for kv in swap.items() for x in kv])
    image = df.select(*[F.coalesce(F.try_element_at(names, F.col(c)), F.col(c)).alias(c) if c == label else F.col(other.get(c, c)).alias(c) for c in df.columns])
    return df.withColumn("mirrored", F.lit(False)).unionByName(image.withColumn("mirrored", F.lit(True)))


def mirror_average(scored: DataFrame, row_id: list[str], left: str, right: str) -> DataFrame:
    """scored (row_id, mirrored, left, right probabilities) -> row_id and the mean of each side's with its mirror image's other side."""
    a, b = (F.when(F.col("mirrored"), F.col(y)).otherwise(F.col(x)) for x, y in ((left, right), (right, left)))
    return scored.groupBy(*row_id).agg(F.avg(a).alias(left), F.avg(b).alias(right))
