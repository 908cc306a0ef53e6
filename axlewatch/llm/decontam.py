"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text is reduced to a template, token by token: marks other than letters and digits go, digits become <num>, a unit
after a number becomes <unit>, a capital with the small letters after it becomes <name>, the rest is lower-cased. Five-token windows of the
templates are joined by hash, so a slot only ever meets a slot of its type. So that a copy in capitals or small letters is
found too, each window has a second key, of the lower-cased words without <name>; an item is judged by each key on its own.

An item counts as contained in a document if, along one alignment (one shift between item and document, or nearby
shifts joined), at least `min_share` of the item's windows occur and its slots are filled consistently: the values of the item
and those of the document correspond one to one (so "Ann has 3 .. Bob .. Ann" matches "Eve has 7 .. Tom .. Eve", but neither
"Eve has 7 .. Tom .. Tom" nor "Eve has 7 .. Eve .. Eve"). A document that leaves enough slots unchanged is a copy and needs no such check.

An item of fewer than five tokens, or one whose windows are nearly all placeholders, has no template to tell it by. It is looked
for verbatim: by the lower-cased tokens themselves, in windows of five or, if it is shorter, of all its tokens.

Defined results: a null text has no windows; an item without a token matches nothing; a template window needs two tokens
that are no placeholders; repeated items are reported each; repeated documents of one id are one document, rows without an
id too; an empty table gives an empty result; docs and items may have columns of any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axlewatch.llm.common import row_of, settled, small

WINDOW = 5
#: Shifts (place in the document less place in the item) at most so far apart may belong to one alignment with small insertions.
NEARBY = 3
NUM, UNIT, NAME = "<num>", "<unit>", "<name>"
#: How a window is keyed: template with names, template of lower-cased words, or the words themselves.
NAMES, LOWER, VERBATIM = 2, 1, 0
UNITS = "mm cm m km in ft mi mg g kg lb oz ml l s sec min h hr hours minutes seconds days weeks months years percent dollars euros pounds cents miles meters metres kilometers kilometres grams kilograms liters litres degrees watts volts"


def stripped(text: Column) -> Column:
    """A text without marks: letters and digits between white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}\s]+", "")


def tokens(text: Column) -> Column:
    """The tokens of a text with their own values."""
    return F.split(F.trim(stripped(text)), r"\s+")


def template(text: Column, names: bool = True) -> Column:
    """The template token for each token of tokens(text). Each token's template depends on the token alone, but a unit's on the number before it.

    Without names the case of letters counts nowhere.
    """
    t = F.regexp_replace(stripped(text) if names else F.lower(stripped(text)), r"[0-9]+", NUM)
    t = F.regexp_replace(t, f"{NUM}\\s+(?:{'|'.join(UNITS.split())})(?=\\s|$)", f"{NUM} {UNIT}")
    if names:
        t = F.regexp_replace(t, r"\p{Lu}\p{Ll}+", NAME)
    return F.split(F.trim(F.lower(t)), r"\s+")


def windows(df: DataFrame, names: bool = True) -> DataFrame:
    """Adds _w (hash of the window of template tokens from each position on).

    Explode _w as outer: for an inner explode the optimizer adds a filter on it, pushes that below these projections and
    so computes the tokens anew for each position.
    """
    df = df.withColumn("_h", F.transform(template(F.col("text"), names), lambda x: F.xxhash64(x)))
    return df.withColumn(
        "_w", F.when(F.size("_h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(F.lit(names), *[F.get(F.col("_h"), i + k) for k in range(WINDOW)])))
    ).drop("_h")


def is_slot(token: Column) -> Column:
    return F.contains(token, F.lit("<"))


def template_windows(items: DataFrame, names: bool = True) -> DataFrame:
    """items(item_id, text) -> a row per window that has two literal tokens: item_id, at, hash, values, slots, n (the item's windows), mode."""
    text = F.col("text")
    w = windows(items.select("item_id", "text", tokens(text if names else F.lower(text)).alias("_v"), template(text, names).alias("_t")), names)
    w = w.select("item_id", "_v", "_t", F.posexplode_outer("_w").alias("at", "hash"))
    w = w.select("item_id", "at", "hash", F.slice("_v", F.col("at") + 1, WINDOW).alias("values"), F.slice("_t", F.col("at") + 1, WINDOW).alias("t"))
    w = w.select("item_id", "at", "hash", F.filter(F.transform("t", lambda x, i: F.when(is_slot(x), i)), lambda x: x.isNotNull()).alias("slots"), "values")
    w = w.where(F.col("hash").isNotNull() & (F.size("slots") <= WINDOW - 2))
    n = w.groupBy("item_id").agg(F.countDistinct("hash").alias("n"))
    return w.join(n, "item_id").withColumn("mode", F.lit(NAMES if names else LOWER))


def verbatim(text: Column) -> Column:
    """The hash of each lower-cased token; nothing for a text without one."""
    return F.transform(F.filter(tokens(F.lower(text)), lambda x: x != ""), lambda x: F.xxhash64(x))


def verbatim_windows(df: DataFrame, sizes: Column) -> DataFrame:
    """Adds _w: for each size the (place, hash) of each window of so many tokens."""
    h = F.col("_h")
    one = lambda n: F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(VERBATIM), n, F.slice(h, i + 1, n)).alias("hash"))))
    return df.withColumn("_h", verbatim(F.col("text"))).withColumn("_w", F.flatten(F.transform(sizes, lambda n: F.coalesce(one(n), F.array().cast("array<struct<at:int,hash:bigint>>"))))).drop("_h")


def item_windows(items: DataFrame) -> DataFrame:
    """The windows of all items, of both templates or verbatim, and the number of tokens of a verbatim one as size."""
    by_template = template_windows(items).unionByName(template_windows(items, False))
    known = by_template.select(F.col("item_id").alias("k_id")).distinct()
    rest = items.select("item_id", "text").join(known, F.col("item_id").eqNullSafe(F.col("k_id")), "left_anti")
    size = F.array(F.least(F.lit(WINDOW), F.greatest(F.lit(1), F.size(verbatim(F.col("text"))))))
    w = verbatim_windows(rest.withColumn("_s", size), F.col("_s")).select("item_id", F.get("_s", F.lit(0)).alias("size"), F.explode("_w").alias("w")).select("item_id", "size", F.col("w.at").alias("at"), F.col("w.hash").alias("hash"))
    n = w.groupBy(F.col("item_id").alias("n_id")).agg(F.countDistinct("hash").alias("n"))
    w = w.join(n, F.col("item_id").eqNullSafe(F.col("n_id"))).drop("n_id")
    w = w.withColumns({"mode": F.lit(VERBATIM), "values": F.array().cast("array<string>"), "slots": F.array().cast("array<int>")})
    return by_template.withColumn("size", F.lit(WINDOW)).unionByName(w)


def document_windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, pos, hash for each kind and size of window that an item has."""
    out = windows(docs).select("doc_id", F.posexplode_outer("_w").alias("pos", "hash")).unionAll(windows(docs, False).select("doc_id", F.posexplode_outer("_w").alias("pos", "hash")))
    sizes = sorted(r.size for r in wanted.where(F.col("mode") == VERBATIM).select("size").distinct().collect())  # of 1 to WINDOW
    if sizes:
        whole = verbatim_windows(docs, F.array(*[F.lit(n) for n in sizes])).select("doc_id", F.explode_outer("_w").alias("w"))
        out = out.unionAll(whole.select("doc_id", F.col("w.at"), F.col("w.hash")))
    return out


def contaminated(docs: DataFrame, items: DataFrame, min_share: float = 0.8, min_consistent: float = 0.8) -> DataFrame:
    """A row per (document, item contained in it): doc_id, item_id, matched and n windows, share, consistent, changed.

    The items' windows are broadcast if a count shows that they are few. Each document window is looked up where the
    document is, and only hits are shuffled, by (document, item).
    """
    wanted = settled(item_windows(items.select("item_id", "text")), "decon-items")
    docs = docs.select("doc_id", "text")
    d = document_windows(docs, wanted)
    hits = settled(d.join(small(wanted.select("hash", "item_id", "mode", "at", "n", "slots")), "hash").select("doc_id", "item_id", "mode", "n", "hash", "pos", "at", "slots"), "decon-hits")
    shares = settled(
        hits.groupBy("doc_id", "item_id", "mode")
        .agg(F.countDistinct("hash").alias("matched"), F.first("n").alias("n"))
        .withColumn("share", F.col("matched") / F.col("n"))
        .where(F.col("share") >= min_share),
        "decon-shares",
    )
    # alignments: each shift, and nearby shifts joined; an item is contained if any of them passes
    key = ["doc_id", "item_id", "mode"]
    shifts = hits.withColumn("shift", F.col("pos") - F.col("at")).select(*key, "n", "hash", "shift")
    enough = small(shares.select(*[F.col(c).alias(f"f_{c}") for c in key]))
    shifts = shifts.join(enough, F.col("doc_id").eqNullSafe(F.col("f_doc_id")) & F.col("item_id").eqNullSafe(F.col("f_item_id")) & (F.col("mode") == F.col("f_mode")), "left_semi")
    by = Window.partitionBy(*key).orderBy("shift")
    joined = shifts.select(*key, "shift").distinct().withColumn("far", (F.col("shift") - F.lag("shift").over(by) > NEARBY).cast("int"))
    joined = joined.withColumn("run", F.sum(F.coalesce("far", F.lit(0))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), x.cast("long").alias("group")) for k, x in (("one", F.col("shift")), ("near", F.col("run")))])).alias("g")
    aligned = settled(joined.select(*[F.col(c).alias(f"g_{c}") for c in key], F.col("shift").alias("g_shift"), kinds).select("g_doc_id", "g_item_id", "g_mode", "g_shift", "g.kind", "g.group"), "decon-aligned")

    def of_group(rows: DataFrame) -> DataFrame:
        on = F.col("doc_id").eqNullSafe(F.col("g_doc_id")) & F.col("item_id").eqNullSafe(F.col("g_item_id")) & (F.col("mode") == F.col("g_mode")) & (F.col("shift") == F.col("g_shift"))
        return rows.join(aligned, on).drop("g_doc_id", "g_item_id", "g_mode", "g_shift")

    group = [*key, "kind", "group"]
    shares = of_group(shifts).groupBy(*group).agg(F.countDistinct("hash").alias("matched"), F.first("n").alias("n")).withColumn("share", F.col("matched") / F.col("n")).where(F.col("share") >= min_share)
    shares = settled(shares, "decon-shares")
    # the values in the slots: only of documents that hold enough windows of an item
    few = small(shares.select(F.col("doc_id").alias("f_doc"), F.col("item_id").alias("f_item"), F.col("mode").alias("f_mode")).distinct())
    at = hits.join(few, F.col("doc_id").eqNullSafe(F.col("f_doc")) & F.col("item_id").eqNullSafe(F.col("f_item")) & (F.col("mode") == F.col("f_mode")), "left_semi")
    at = at.select("doc_id", "item_id", "mode", "hash", "at", (F.col("pos") - F.col("at")).alias("shift"), F.explode("slots").alias("k"))
    mine = wanted.select(F.col("item_id").alias("w_item"), F.col("mode").alias("w_mode"), F.col("at").alias("w_at"), F.posexplode("values").alias("w_k", "a"))
    theirs = docs.join(small(shares.select(F.col("doc_id").alias("f_doc")).distinct()), F.col("doc_id").eqNullSafe(F.col("f_doc")), "left_semi")
    theirs = theirs.select(F.col("doc_id").alias("v_doc"), F.posexplode(tokens(F.col("text"))).alias("v_pos", "b"))
    slots = (
        at.join(small(mine), F.col("item_id").eqNullSafe(F.col("w_item")) & (F.col("mode") == F.col("w_mode")) & (F.col("at") == F.col("w_at")) & (F.col("k") == F.col("w_k")))
        .join(theirs, F.col("doc_id").eqNullSafe(F.col("v_doc")) & (F.col("shift") + F.col("at") + F.col("k") == F.col("v_pos")))
        .withColumn("b", F.when(F.col("mode") == NAMES, F.col("b")).otherwise(F.lower("b")))
    )
    # a value of the item and one of the document belong together if neither meets another; values that could not fail don't count
    met = of_group(slots).groupBy(*group, "a", "b").agg(F.collect_set("v_pos").alias("at"))
    met = met.withColumn("bs", F.count(F.lit(1)).over(Window.partitionBy(*group, "a"))).withColumn("as", F.count(F.lit(1)).over(Window.partitionBy(*group, "b")))
    union = lambda x: F.array_distinct(F.flatten(F.collect_list(x)))
    values = met.groupBy(*group, "a").agg(F.max("bs").alias("bs"), F.max("as").alias("as"), union("at").alias("at"), union(F.when(F.col("a") == F.col("b"), F.col("at"))).alias("kept"))
    telling = (F.size("at") > 1) | (F.col("bs") > 1) | (F.col("as") > 1)
    slots = values.groupBy(*group).agg(
        F.avg(F.when(telling, ((F.col("bs") == 1) & (F.col("as") == 1)).cast("double"))).alias("consistent"), F.size(union("at")).alias("places"), F.size(union("kept")).alias("same")
    )
    s = slots.select(*[F.col(c).alias(f"s_{c}") for c in group], "consistent", "places", "same")
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    fits = (
        shares.join(s, same, "left")
        .withColumn("consistent", F.coalesce("consistent", F.lit(1.0)))
        .where((F.col("consistent") >= min_consistent) | (F.col("same") >= min_consistent * F.col("places")))
        .select("doc_id", "item_id", "mode", F.col("matched").cast("long").alias("matched"), F.col("n").cast("long").alias("n"), "share", "consistent", F.coalesce(F.col("places") - F.col("same"), F.lit(0)).cast("long").alias("changed"))
    )
    # one row where several fit: that of the largest share
    best = fits.groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "mode", "matched", "n", "consistent", "changed")).alias("m"))
    return best.select("doc_id", "item_id", "m.matched", "m.n", "m.share", "m.consistent", "m.changed")


def without_contaminated(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """docs without the rows whose text contains an item. Rows are known by a hash of id and text, so rows of one id, or without an id, are decided one by one; only the hashes found are shuffled if they are few."""
    rows = docs.select(row_of(docs).alias("row"), F.xxhash64("doc_id", "text").alias("doc_id"), F.col("text").alias("text"))
    bad = settled(contaminated(rows, items, **kw).select(F.col("doc_id").alias("bad_id")).distinct(), "decon-ids")
    return rows.join(small(bad), F.col("doc_id") == F.col("bad_id"), "left_anti").select("row.*")
