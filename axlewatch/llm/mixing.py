"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Sources get a share of a word budget by weight; a source that would be read more than `max_epochs` times is clamped
there and its excess goes to the others by weight, until none is above. Each document is then repeated
floor(target / source size) times, and documents in a seeded order are taken once more until the target is reached.

Defined results: a null text has size 0; the null source is a source of its own and comes last; a source of size 0 gets
target 0; rows equal in doc_id and text are taken alike, other rows of one doc_id, or of none, one by one; an empty table
gives an empty result; columns of the documents may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axlewatch.llm.common import n_words, row_of, settled, small

#: Hexadecimal digits of the order key that make a bin: 4096 bins a source, so a source of any size is summed by bin.
BIN_DIGITS = 3


def order_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A seeded order of documents that doesn't depend on partitions; documents of one id follow each other by their texts."""
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), F.md5(F.coalesce(text, F.lit(""))))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """sizes(source, source_size), a row per source -> with target.

    In the order of cap / weight, the running sums of caps and weights are the rounds of clamping: a source is clamped
    if its ratio is at most the level at which the sources from it on would share what the sources before it leave.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"),
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        ranked.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("clamped", F.col("cap") / F.col("weight") <= F.col("level"))
        .withColumn("water", F.max(F.when(~F.col("clamped"), F.col("level"))).over(every))
        .select("source", "source_size", F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("weight") * F.coalesce(F.col("water"), F.lit(0.0))).alias("target"))
    )


def mixing_plan(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """A row per source: source_size, target, whole (repetitions of each document) and the last key that is taken once more.

    docs: doc_id, text, source. Sums go by (source, bin of the order key) before any shuffle, so a source with a third
    of all rows is as cheap as another; only the one bin in which a target is reached is ordered by row.
    """
    sized = settled(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), order_key(F.col("doc_id"), F.col("text"), seed).alias("key")), "mix-sizes")
    binned = sized.withColumn("bin", F.substring("key", 1, BIN_DIGITS))
    by_bin = settled(binned.groupBy("source", "bin").agg(F.sum("size").alias("words")), "mix-bins")
    sizes = by_bin.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = settled(
        source_targets(sizes, weights, share, max_epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-targets",
    )
    t = targets.select(F.col("source").alias("t_source"), "need")
    up_to = Window.partitionBy("source").orderBy("bin")
    reached = (
        by_bin.join(small(t), F.col("source").eqNullSafe(F.col("t_source")))
        .withColumn("upto", F.sum("words").over(up_to))
        .where((F.col("need") > 0) & (F.col("upto") >= F.col("need")))
        .groupBy("source")
        .agg(F.min(F.struct("bin", (F.col("need") - F.col("upto") + F.col("words")).alias("left"))).alias("at"))
        .select(F.col("source").alias("r_source"), F.col("at.bin").alias("r_bin"), F.col("at.left").alias("left"))
    )
    reached = settled(reached, "mix-reached")
    by_key = Window.partitionBy("source").orderBy("key")
    last = (
        binned.join(small(reached), F.col("source").eqNullSafe(F.col("r_source")) & (F.col("bin") == F.col("r_bin")))
        .groupBy("source", "key", "left")
        .agg(F.sum("size").alias("size"))
        .withColumn("before", F.sum("size").over(by_key.rowsBetween(Window.unboundedPreceding, -1)))
        .where(F.coalesce(F.col("before"), F.lit(0)) + F.col("size") / 2 <= F.col("left"))
        .groupBy("source")
        .agg(F.max("key").alias("last_key"))
        .select(F.col("source").alias("l_source"), "last_key")
    )
    return settled(
        targets.join(small(reached), F.col("source").eqNullSafe(F.col("r_source")), "left")
        .join(last, F.col("source").eqNullSafe(F.col("l_source")), "left")
        .select(F.col("source").alias("p_source"), "source_size", "target", "whole", F.coalesce("last_key", "r_bin", F.lit("")).alias("last_key")),
        "mix-plan",
    )


def repetitions(docs: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """docs as a struct `row`, with source_size, target and `times`, how often the mix takes the document."""
    p = small(plan)
    rows = docs.select(row_of(docs).alias("row"), order_key(F.col("doc_id"), F.col("text"), seed).alias("key"))
    return rows.join(p, F.col("row.source").eqNullSafe(F.col("p_source"))).select("row", "source_size", "target", (F.col("whole") + (F.col("key") <= F.col("last_key")).cast("long")).alias("times"))


def mix_sizes(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words that the mix takes of it, repeats counted)."""
    docs = docs.select("doc_id", "text", "source")
    out = repetitions(docs, mixing_plan(docs, weights, share, max_epochs, seed), seed)
    return out.select(F.col("row.doc_id").alias("doc_id"), n_words(F.col("row.text")).alias("size"), "source_size", "target", "times").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    out = repetitions(docs, mixing_plan(docs, weights, share, max_epochs, seed), seed)
    return out.where("times > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("copy")).select("row.*")
