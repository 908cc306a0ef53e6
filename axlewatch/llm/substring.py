"""Substring dedup: digests of lines and of word runs, grouped globally; the earliest ranked occurrence stays.

Units are lines (their lower-cased words) and, inside lines and across them, runs of RUN words. A unit that also stands
earlier, by (doc_id, hash of the text, word), is a repeat. Repeated lines of `min_line_words` or more go, wherever they are
found; and so does each passage of `min_words` or more words made of repeated runs, with its offsets in the original text.

Not every run is shuffled. Of each CHOICE runs in a row the one of the least hash is chosen, so equal passages choose equal
runs: each passage of RUN + CHOICE - 1 = 19 words holds one at least, and neighbours overlap or touch. A passage is then
extended, word by word on the texts themselves, as far as it equals the earliest occurrence of its first and last run, so it
is exact to the word; only where another text than that holds more of it, under CHOICE words at an edge may stay.

Defined results: a null text has no units; a null doc_id ranks last; rows equal in doc_id and text are one document and
are cut alike, rows of one doc_id with other texts are other documents; white space alone is no unit; an empty table
gives an empty result; docs may have columns of any names (a column `removed` is replaced by without_repeats).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axlewatch.llm.common import batches_of, row_of, run_hashes, settled

RUN, CHOICE = 10, 10
MIN_WORDS = 20
#: A unit found this often or more is hot: its rows are salted, so no task gets all of them.
HOT, SALTS = 20_000, 64
#: Rows that Python gets at once, bytes of text that are looked at in one go, words whose choices are made in one go.
BATCH_ROWS, SLICE_BYTES, BLOCK = 1000, 4 << 20, 1 << 20
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WHITE = np.zeros(256, bool)
WHITE[[*range(9, 14), 32]] = True
FACTOR = 0x9E3779B97F4A7C15
POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of FACTOR and of its inverse, modulo 2 ** 64."""
    if len(POWERS.get("up", ())) < n:
        size = np.uint64(max(n, BLOCK) * 5 // 4)
        for name, x in (("up", FACTOR), ("down", pow(FACTOR, -1, 1 << 64))):
            POWERS[name] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, x, np.uint64))])
    return POWERS["up"][:n], POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of data: sums of bytes times powers, block by block."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = powers(b - a)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up)])
        out[i:j] = (sums[ends[i:j] - a] - sums[starts[i:j] - a]) * down[starts[i:j] - a]
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


def units(texts: pa.StringArray, min_line_words: int) -> tuple[np.ndarray, ...]:
    """(text, first word, words, h, h2) of the chosen runs and of the lines of all texts; h2 is 0 for runs alone."""
    low = pc.utf8_lower(texts)
    offsets = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64)
    data = np.frombuffer(low.buffers()[2], np.uint8)[: offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
    white = WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    black = ~white
    starts = np.flatnonzero(black & (edge[:-1] | np.concatenate([[True], white[:-1]])))
    ends = np.flatnonzero(black & (edge[1:] | np.concatenate([white[1:], [True]]))) + 1
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    h = word_hashes(data, starts, ends)
    chosen = [np.zeros(0, np.int64)]
    runs, span = run_hashes(h, RUN, FACTOR), RUN + CHOICE - 1
    for a in range(0, len(h) - span + 1, BLOCK):
        n = min(BLOCK, len(h) - span + 1 - a)
        least = np.lib.stride_tricks.sliding_window_view(runs[a : a + n + CHOICE - 1], CHOICE).argmin(axis=1) + np.arange(a, a + n)
        chosen.append(least[doc[a : a + n] == doc[a + span - 1 : a + n + span - 1]])
    at = np.unique(np.concatenate(chosen))
    feeds = np.cumsum(data == 10)[starts]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (feeds[1:] != feeds[:-1])]))
    size = np.diff(np.append(first, len(starts)))
    place = (np.arange(len(starts)) - np.repeat(first, size)).astype(np.uint64)
    line = [np.add.reduceat(mix(h + place * np.uint64(k)), first) for k in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
    long = size >= min_line_words
    first, size, line = first[long], size[long], [x[long] for x in line]
    every = np.concatenate([at, first])
    begin = np.searchsorted(doc, doc[every])
    return (
        doc[every], every - begin, np.concatenate([np.full(len(at), RUN), size]),
        np.concatenate([runs[at], line[0]]), np.concatenate([np.zeros(len(at), np.uint64), line[1] | np.uint64(1)]),
    )


def text_hash() -> Column:
    return F.xxhash64("text")


def unit_table(docs: DataFrame, min_line_words: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, t (the text's hash), at (word), words, h, h2."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            part = np.cumsum(pc.binary_length(texts).to_numpy()) // SLICE_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                doc, at, words, h, h2 = units(texts.slice(a, b - a), min_line_words)
                rows = pa.array(doc + a)
                columns = [batch.column(0).take(rows), batch.column(2).take(rows), pa.array(at, pa.int32()), pa.array(words, pa.int32()), pa.array(h.view(np.int64)), pa.array(h2.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "at", "words", "h", "h2"])
            pa.default_memory_pool().release_unused()

    out = [docs.schema["doc_id"], T.StructField("t", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in ("at", "words")], *[T.StructField(c, T.LongType()) for c in ("h", "h2")]]
    return docs.select("doc_id", "text", text_hash().alias("t")).where("text is not null").mapInArrow(each, T.StructType(out))


def salted_join(rows: DataFrame, owners: DataFrame, on: dict[str, str], spread: list[str]) -> DataFrame:
    """rows with the other columns of owners (a row per key, with its count n in rows). on names a column of rows for each of owners;
    nulls are equal. Rows of a hot key go to SALTS tasks by the columns `spread`. Only hot keys are broadcast, at most rows / HOT, and only if
    they are few; where they aren't, each key is salted."""
    hot = settled(owners.where(F.col("n") >= HOT).select(*[F.col(k).alias(f"_h_{k}") for k in on.values()]), "hot-units")
    few = hot.limit(100_001).count()
    salts = F.when(F.col("n") >= HOT, SALTS).otherwise(1) if few <= 100_000 else F.lit(SALTS)
    sown = owners.select(*[F.col(k).alias(f"_o_{k}") for k in on.values()], *[c for c in owners.columns if c not in (*on.values(), "n")], F.explode(F.sequence(F.lit(0), salts - 1)).alias("_o_salt"))

    def same(prefix: str) -> Column:
        out = F.lit(True)
        for a, b in on.items():
            out = out & F.col(a).eqNullSafe(F.col(f"{prefix}{b}"))
        return out

    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    if few == 0:
        salted = rows.withColumn("_salt", F.lit(0))
    elif few <= 100_000:
        salted = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), same("_h_"), "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot", *[f"_h_{k}" for k in on.values()])
    else:
        salted = rows.withColumn("_salt", salt)
    return salted.join(sown, same("_o_") & (F.col("_salt") == F.col("_o_salt"))).drop("_salt", "_o_salt", *[f"_o_{k}" for k in on.values()])


def merged(pieces: DataFrame, begin: str, end: str) -> DataFrame:
    """pieces(doc_id, t, begin, end, ..) with run: the number of their stretch; stretches neither overlap nor touch."""
    by = Window.partitionBy("doc_id", "t").orderBy(begin, end)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    x = pieces.withColumn("_reach", reach)
    return x.withColumn("run", F.sum((F.col(begin) > F.coalesce("_reach", F.lit(-1))).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_reach")


def neighbours(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(doc_id, t, pos, side) -> with words, the CHOICE - 1 words before (side 0) or from (side 1) the place on, outwards, and chars:
    the offset of the edge if 0, 1, .. of them belong to the passage."""
    asked = wanted.groupBy("doc_id", "t").agg(F.collect_set(F.struct("pos", "side")).alias("places")).select(F.col("doc_id").alias("w_id"), F.col("t").alias("w_t"), "places")
    texts = docs.select("doc_id", "text", text_hash().alias("t"))
    both = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("t") == F.col("w_t"))).select("doc_id", "t", "text", "places")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, sides, words, chars = [], [], [], [], []
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                spans = [m.span() for m in WORD.finditer(text)]
                for p in batch.column(3)[i].as_py():
                    pos, side = p["pos"], p["side"]
                    near = spans[pos : pos + CHOICE - 1] if side else spans[max(pos - CHOICE + 1, 0) : pos][::-1]
                    rows.append(i), places.append(pos), sides.append(side)
                    words.append([text[a:b].lower() for a, b in near])
                    chars.append([spans[pos - 1][1], *[b for _, b in near]] if side else [spans[pos][0], *[a for a, _ in near]])
            at = pa.array(rows, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(places, pa.int32()), pa.array(sides, pa.int32()), pa.array(words, pa.list_(pa.string())), pa.array(chars, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "pos", "side", "words", "chars"])

    out = [docs.schema["doc_id"], T.StructField("t", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("side", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("chars", T.ArrayType(T.IntegerType()))]
    return both.mapInArrow(each, T.StructType(out))


def passages(docs: DataFrame, min_words: int, min_line_words: int) -> DataFrame:
    """doc_id, t, start_char, end_char, n_words, n_units (repeated lines in it), kept_doc_id (that of its first repeat)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    with batches_of(spark, BATCH_ROWS):
        u = settled(unit_table(docs, min_line_words), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("t").alias("t"), F.col("at").alias("at"))
    first = settled(u.groupBy("h", "h2").agg(F.min(rank).alias("k"), F.count(F.lit(1)).alias("n")).where("n > 1"), "unit-first")
    again = salted_join(u, first, {"h": "h", "h2": "h2"}, ["doc_id", "t"])
    again = again.where(~(F.col("doc_id").eqNullSafe(F.col("k.id")) & (F.col("t") == F.col("k.t")) & (F.col("at") == F.col("k.at"))))
    again = settled(again.select("doc_id", "t", "at", (F.col("at") + F.col("words")).alias("to"), (F.col("h2") != 0).alias("line"), F.col("k.id").alias("k_id"), F.col("k.t").alias("k_t"), F.col("k.at").alias("k_at")), "unit-again")
    edge = F.struct("at", "to", "k_id", "k_t", "k_at")
    runs = merged(again.where("not line"), "at", "to").groupBy("doc_id", "t", "run").agg(F.min(edge).alias("head"), F.max(edge).alias("tail"))
    # the two edges of each run and of each line; a line's edges have no twin and stay
    far = F.array(
        F.struct(F.lit(0).alias("side"), F.col("head.at").alias("pos"), F.col("head.k_id").alias("k_id"), F.col("head.k_t").alias("k_t"), F.col("head.k_at").alias("k_pos")),
        F.struct(F.lit(1).alias("side"), F.col("tail.to").alias("pos"), F.col("tail.k_id").alias("k_id"), F.col("tail.k_t").alias("k_t"), (F.col("tail.k_at") + RUN).alias("k_pos")),
    )
    edges = runs.select("doc_id", "t", F.lit(False).alias("line"), F.col("run").alias("no"), F.col("head.k_id").alias("kept"), F.explode(far).alias("e")).select("doc_id", "t", "line", "no", "kept", "e.*")
    none = again.schema
    own = F.array(
        *[F.struct(F.lit(s).alias("side"), F.col(c).alias("pos"), F.lit(None).cast(none["k_id"].dataType).alias("k_id"), F.lit(None).cast("long").alias("k_t"), F.lit(None).cast("int").alias("k_pos")) for s, c in ((0, "at"), (1, "to"))]
    )
    lines = again.where("line").select("doc_id", "t", "line", F.col("at").cast("long").alias("no"), F.col("k_id").alias("kept"), F.explode(own).alias("e")).select("doc_id", "t", "line", "no", "kept", "e.*")
    edges = settled(edges.unionByName(lines), "unit-edges")
    twins = edges.where("k_t is not null").groupBy(F.col("k_id").alias("doc_id"), F.col("k_t").alias("t"), F.col("k_pos").alias("pos"), "side").agg(F.count(F.lit(1)).alias("n"))
    wanted = edges.select("doc_id", "t", "pos", "side").unionByName(twins.select("doc_id", "t", "pos", "side"))
    near = neighbours(docs, wanted)
    if docs.groupBy("doc_id", text_hash()).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        near = near.dropDuplicates(["doc_id", "t", "pos", "side"])  # rows that are equal in id and text
    with batches_of(spark, BATCH_ROWS):
        near = settled(near, "unit-neighbours")
    key = ["doc_id", "t", "pos", "side"]
    mine = near.select(*[F.col(c).alias(f"m_{c}") for c in key], F.col("words").alias("m_words"), "chars")
    on = F.col("doc_id").eqNullSafe(F.col("m_doc_id")) & (F.col("t") == F.col("m_t")) & (F.col("pos") == F.col("m_pos")) & (F.col("side") == F.col("m_side"))
    placed = edges.join(mine, on).drop(*[f"m_{c}" for c in key])
    theirs = near.join(twins, (near["doc_id"].eqNullSafe(twins["doc_id"])) & (near["t"] == twins["t"]) & (near["pos"] == twins["pos"]) & (near["side"] == twins["side"])).select(near["doc_id"], near["t"], near["pos"], near["side"], near["words"].alias("k_words"), "n")
    met = salted_join(placed.where("k_t is not null"), theirs, {"k_id": "doc_id", "k_t": "t", "k_pos": "pos", "side": "side"}, ["doc_id", "t"])
    equal = F.aggregate(F.zip_with("m_words", "k_words", lambda a, b: F.coalesce(a == b, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])
    columns = ["doc_id", "t", "line", "no", "kept", "side", "pos", "chars"]
    done = met.select(*columns, equal.alias("more")).unionByName(placed.where("k_t is null").select(*columns, F.lit(0).alias("more")))
    at = lambda side, x: F.max(F.when(F.col("side") == side, x))
    char = F.get("chars", F.col("more"))
    found = done.groupBy("doc_id", "t", "line", "no", "kept").agg(at(0, F.col("pos") - F.col("more")).alias("from"), at(1, F.col("pos") + F.col("more")).alias("to"), at(0, char).alias("a"), at(1, char).alias("z"))
    # runs that came together by their extension are one passage
    whole = merged(found.where("not line"), "from", "to").groupBy("doc_id", "t", "run").agg(F.min(F.struct("from", "kept")).alias("f"), F.max("to").alias("to"), F.min("a").alias("a"), F.max("z").alias("z"))
    whole = whole.select("doc_id", "t", F.col("f.from").alias("from"), "to", "a", "z", F.col("f.kept").alias("kept"), F.lit(0).alias("unit")).where(F.col("to") - F.col("from") >= min_words)
    every = merged(whole.unionByName(found.where("line").select("doc_id", "t", "from", "to", "a", "z", "kept", F.lit(1).alias("unit"))), "from", "to")
    out = every.groupBy("doc_id", "t", "run").agg(F.min("a").alias("a"), F.max("z").alias("z"), (F.max("to") - F.min("from")).alias("n"), F.sum("unit").alias("u"), F.min(F.struct("from", "kept")).alias("f"))
    return out.select("doc_id", "t", *[F.col(x).cast("long").alias(y) for x, y in (("a", "start_char"), ("z", "end_char"), ("n", "n_words"), ("u", "n_units"))], F.col("f.kept").alias("kept_doc_id"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, min_line_words: int = 1) -> DataFrame:
    """A row per passage to remove: doc_id, start_char, end_char, n_words, n_units, kept_doc_id."""
    return passages(docs, min_words, min_line_words).drop("t")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, min_line_words: int = 1) -> DataFrame:
    """docs with the passages cut from text; `removed` lists (start_char, end_char) in the original text."""
    found = passages(docs, min_words, min_line_words)
    spans = found.groupBy("doc_id", "t").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char"))).alias("spans")).select(F.col("doc_id").alias("s_id"), F.col("t").alias("s_t"), "spans")
    rows = docs.select(row_of(docs).alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), text_hash().alias("t"))
    both = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("t") == F.col("s_t")), "left")
    cut = F.aggregate(
        "spans", F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("at")), lambda a, s: F.struct(F.concat(a["t"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start_char"] - a["at"]).cast("int"))).alias("t"), s["end_char"].alias("at")),
        lambda a: F.concat(a["t"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text"))),
    )
    none = F.array().cast(spans.schema["spans"].dataType)
    return both.select(*[F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != "removed"], F.coalesce("spans", none).alias("removed"))
