"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

A rule rejects a text whose metric is above (or below) a cutoff. All rules tighten together: level j applies the j-th cutoff
of each rule, and a text's own level is the mildest one that rejects it. For each stratum labelled good texts, held out for
this, choose the level: from the mildest on, level j is accepted if k of n good texts are rejected by any rule at it and
P(Bin(n, alpha) <= k) is at most delta / strata, the exact (Clopper-Pearson) bound; the first level that fails ends the
sequence. Levels are nested and tested in fixed order, so only strata need the (Bonferroni) correction, and with
probability 1 - delta no stratum loses more than the share `alpha` of its good texts to all rules together. What the base
rule rejects isn't the method's to reject and doesn't count. A fifth of the good texts takes no part in the choice;
`audit` measures the rejected share on them.

Defined results: a null text has no words; a text without words fails the base rule; null strata form one stratum;
ratios of a text without words are 0; a stratum with too few labels gets no level; an empty label table leaves the base
rule alone; a doc_id that is labelled twice counts with its best label, each of its rows alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axlewatch.llm.common import WORD, settled, small

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

#: rule -> (metric, whether large values are bad, its cutoff at each level)
RULES: dict[str, tuple[str, bool, tuple[float, ...]]] = {
    "symbols": ("r_symbols", True, (2.0, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.02)),
    "repeats": ("r_repeats", True, (0.19, 0.18, 0.17, 0.16, 0.15, 0.14, 0.13, 0.12, 0.11, 0.1, 0.08, 0.05)),
    "lines": ("r_lines", True, (0.9, 0.8, 0.7, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    "capitals": ("r_capitals", True, (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
    "long words": ("r_word", True, (60.0, 50.0, 40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 15.0, 14.0, 13.0, 12.0)),
    "short words": ("r_word", False, (1.0, 1.2, 1.4, 1.6, 1.8, 2.0, 2.2, 2.4, 2.6, 2.8, 3.0, 3.2)),
}
LEVELS = 12
#: Good texts of this remainder of the hash of their id, of AUDIT, are left out of the choice.
AUDIT = 5


def base_metrics(docs: DataFrame) -> DataFrame:
    """docs(id columns.., text) -> the same without text, with the counts that the rules read.

    Words in repeated windows: a text with equal windows sorts them with their positions, keeps those equal to a
    neighbour, and each adds the words that the kept window before it doesn't cover.
    """
    keep = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    w = docs.select(*keep, text.alias("_t"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("_l"))
    # each step is a projection of its own, so that no array is computed twice; texts and words leave as early as can be
    w = w.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    w = w.withColumn(
        "_g",
        F.when(F.size("_h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")),
    ).drop("_h")
    w = w.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.array_sort(F.arrays_zip(F.col("_g").alias("h"), F.sequence(F.lit(1), F.size("_g")).alias("p"))))).drop("_g")
    twice = F.filter("_s", lambda x, i: ((i > 0) & (F.get(F.col("_s"), i - 1)["h"] == x["h"])) | F.coalesce(F.get(F.col("_s"), i + 1)["h"] == x["h"], F.lit(False)))
    w = w.withColumn("_at", F.when(F.col("_s").isNotNull(), F.array_sort(F.transform(twice, lambda x: x["p"])))).drop("_s")
    covered = F.aggregate("_at", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return w.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def ratios() -> dict[str, Column]:
    def of(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "r_symbols": of("n_symbols", "n_words"),
        "r_repeats": of("n_repeat_words", "n_words"),
        "r_lines": of("n_dup_lines", "n_lines"),
        "r_capitals": of("n_capitals", "word_chars"),
        "r_word": of("word_chars", "n_words"),
    }


def binomial_at_most(k: Column, n: Column, alpha: float) -> Column:
    """P(Bin(n, alpha) <= k), summed term by term; terms are kept in logarithms, so a large n doesn't underflow."""
    start = n * F.lit(math.log1p(-alpha))
    odds = F.lit(math.log(alpha) - math.log1p(-alpha))
    terms = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(start.alias("term"), start.alias("total")),
        lambda a, i: F.struct(
            (a["term"] + F.log((n - i + 1) / i) + odds).alias("term"),
            (F.greatest(a["total"], a["term"] + F.log((n - i + 1) / i) + odds) + F.log1p(F.exp(-F.abs(a["total"] - (a["term"] + F.log((n - i + 1) / i) + odds))))).alias("total"),
        ),
        lambda a: a["total"],
    )
    return F.exp(terms)


def own_level() -> Column:
    """The mildest level that rejects a text with these ratios; LEVELS if none does."""
    firsts = []
    for metric, large, cuts in RULES.values():
        when = F.when(F.lit(False), F.lit(0))
        for j, cut in enumerate(cuts):
            when = when.when((F.col(metric) > cut) if large else (F.col(metric) < cut), F.lit(j))
        firsts.append(when.otherwise(F.lit(LEVELS)))
    return F.least(*firsts)


def audited(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("audit"), doc_id), F.lit(AUDIT)) == 0


def calibrate(good: DataFrame, stratum: str, alpha: float, delta: float) -> DataFrame:
    """good(stratum, level), a row per labelled good text -> stratum, allowed: the strictest level that the stratum may use.

    Rows are counted by (stratum, level) before any shuffle; the running sums are over LEVELS rows a stratum.
    """
    counts = settled(good.groupBy(F.col(stratum).alias("stratum"), "level").agg(F.count(F.lit(1)).alias("c")), "rule-counts")
    every = counts.groupBy("stratum").agg(F.sum("c").alias("n"))
    strata = every.agg(F.count(F.lit(1)).alias("strata"))
    ladder = every.join(F.broadcast(strata)).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))  # one row of strata
    c = counts.select(F.col("stratum").alias("c_stratum"), F.col("level").alias("c_level"), "c")
    ladder = ladder.join(c, F.col("stratum").eqNullSafe(F.col("c_stratum")) & (F.col("c_level") == F.col("step")), "left")
    up = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    ladder = ladder.withColumn("k", F.sum(F.coalesce("c", F.lit(0))).over(up))
    bound = F.when((F.col("k") < F.lit(alpha) * F.col("n")) | (F.col("k") == 0), binomial_at_most(F.col("k"), F.col("n"), alpha)).otherwise(F.lit(1.0))
    ladder = ladder.withColumn("failed", F.max((bound > F.lit(delta) / F.col("strata")).cast("int")).over(up))
    return ladder.where("failed = 0").groupBy("stratum").agg(F.max("step").alias("allowed"))


def measured(metrics: DataFrame) -> DataFrame:
    """metrics with base_failed and level."""
    return metrics.withColumns(ratios()).withColumns({"base_failed": base_failed(), "level": own_level()})


def apply_rules(metrics: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """metrics(doc_id, stratum, counts..) and labels(doc_id, quality) -> with base_failed, level, allowed and kept."""
    m = settled(measured(metrics), "rule-metrics")
    good = labels.where("quality = 1").select("doc_id").distinct().where(~audited(F.col("doc_id")))
    allowed = settled(calibrate(m.where(~F.col("base_failed")).join(good, "doc_id", "left_semi"), stratum, alpha, delta), "rule-levels")
    joined = m.join(small(allowed), F.col(stratum).eqNullSafe(F.col("stratum")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("level") > F.coalesce("allowed", F.lit(-1))))


def audit(applied: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """applied (of apply_rules) -> stratum, good, rejected: of good texts that took no part in the choice, how many pass the base rule and how many of these the rules reject."""
    held = labels.where("quality = 1").select("doc_id").distinct().where(audited(F.col("doc_id")))
    rows = applied.where(~F.col("base_failed")).join(held, "doc_id", "left_semi")
    return rows.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("good"), F.count(F.when(~F.col("kept"), 1)).alias("rejected"))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """docs(doc_id, text, lang) -> a row per document: the counts, base_failed, kept and the level that rejects it (LEVELS: none)."""
    out = apply_rules(base_metrics(docs.select("doc_id", "lang", "text")), labels, "lang", alpha, delta)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "level")
