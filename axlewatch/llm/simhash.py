"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits over the 3-word shingles of a text. Two fingerprints that differ in at most 3 bits differ in
at most 1 bit in one of their 32-bit halves. So each distinct fingerprint is stored once under each half, looked up
under each value of a Hamming ball of radius 1 around each half (33 values), and each match's whole distance is verified
in the join. Components are found over distinct fingerprints; documents are only attached at the end.

Defined results: a null or empty text, or one without words, has fingerprint 0, which links like any other; repeated
rows keep their rows; a null doc_id is never a component id unless all of a component's ids are null; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axlewatch.llm.common import BROADCAST_ROWS, row_of, run_hashes, settled, small  # noqa: F401

SHINGLE, BITS, SEED = 3, 64, 42
#: Shingles that are counted at once, so that a very long text needs no more memory than a short one.
BLOCK = 1 << 16
#: Words of a shingle where texts are compared by similarity.
WIDE = 5


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint as a signed integer: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED)).astype(np.int64))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = starts + lengths
    n = len(words) - SHINGLE + 1
    ones = np.zeros(BITS, dtype=np.int64)
    hash64 = xxhash.xxh64_intdigest
    for a in range(0, n, BLOCK):
        b = min(a + BLOCK, n)
        h = np.array([hash64(joined[s:e], SEED) for s, e in zip(starts[a:b].tolist(), ends[a + SHINGLE - 1 : b + SHINGLE - 1].tolist(), strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0].astype(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["doc_id", "fp"])

    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(each, out)


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """fps(fp), distinct -> (a, b), a < b, the pairs that differ in 1 to `distance` (at most 3) bits."""
    halves = F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit((1 << 32) - 1)))
    stored = fps.select("fp", F.posexplode(halves).alias("half", "key"))
    ball = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    asked = stored.select(F.col("fp").alias("q"), "half", F.explode(F.transform(ball, lambda m: F.col("key").bitwiseXOR(m))).alias("key"))
    near = (F.col("fp") > F.col("q")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("q"))) <= distance)
    pairs = asked.join(stored, on=[asked["half"] == stored["half"], asked["key"] == stored["key"], near])
    return pairs.select(F.col("q").alias("a"), F.col("fp").alias("b")).distinct()


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles of WIDE words; none below WIDE words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(run_hashes(np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64), WIDE, 0x9E3779B97F4A7C15))


def sketches(docs: DataFrame, similar: bool, percent: int = 80) -> DataFrame:
    """docs(doc_id, text, h) -> doc_id, h, fp and, if wanted, n (shingles), key (a digest of the text's set of shingles) and bands and map (its keys and its bitmap in the exact join, at least once for each set); these are null below WIDE words."""
    from axlewatch.llm import jaccard

    t = jaccard.Threshold(percent)
    marks = docs.sparkSession.sparkContext.broadcast(jaccard.token_marks(docs, WIDE) if similar else None)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = jaccard.Sketch(t, marks.value) if similar else None
        for batch in batches:
            fps, sizes, keys, bands, maps = [], [], [], [], []
            for x in batch.column(1):
                text = x.as_py()
                fps.append(fingerprint(text))
                s = shingles(text) if similar else ()
                key, band, bits = sketch.of(s) if similar else (None, None, None)
                sizes.append(len(s) or None), keys.append(key), bands.append(band), maps.append(bits)
            columns = [batch.column(0), batch.column(2), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "fp", "n", "key", "bands", "map"])

    out = [docs.schema["doc_id"], *[T.StructField(n, t) for n, t in (("h", T.LongType()), ("fp", T.LongType()), ("n", T.LongType()), ("key", T.BinaryType()), ("bands", T.ArrayType(T.LongType())), ("map", T.BinaryType()))]]
    return docs.select("doc_id", "text", "h").mapInArrow(each, T.StructType(out))


def similar_roots(rows: DataFrame, every: DataFrame, classes: DataFrame, edges: DataFrame, similarity: float) -> DataFrame:
    """fp, first, root as `roots_of` gives them, where texts with this similarity (a whole number of hundredths) are linked besides `edges`.

    Equal sets collapse first; the links of distinct ones are those of the exact join of `jaccard`, which loses none:
    sets of this similarity share a key, and a tree of keys leaves out only pairs that bounds rule out or that are
    connected already. Texts of fewer than five words are only compared by fingerprint.
    """
    from axlewatch.llm import jaccard

    t = jaccard.Threshold(percent_of(similarity))
    kept = every.where("key is not null")
    reps = kept.groupBy("key").agg(F.min(F.struct("doc_id", "h", "fp")).alias("rep"), F.first("n").alias("n"), F.first("map", True).alias("map")).checkpoint()
    same = kept.join(reps.select("key", F.col("rep.fp").alias("a")), "key").select("a", F.col("fp").alias("b")).where("a <> b").distinct()
    found = jaccard.links(rows, kept.select(F.col("key").alias("node"), "n", F.col("bands").alias("keys")), reps.select(F.col("key").alias("node"), "n", F.struct("rep.doc_id", "rep.h").alias("rep"), "map"), WIDE, t, F.col("h"))
    named = [reps.select(F.col("key").alias(c), F.col("rep.fp").alias(f"{c}_fp")) for c in "ab"]
    near = found.join(named[0], "a").join(named[1], "b").select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")).where("a <> b").distinct()
    return roots_of(classes, edges.unionAll(same).unionAll(near))


def percent_of(similarity: float) -> int:
    if abs(100 * similarity - round(100 * similarity)) > 1e-9:
        raise ValueError("similarity must be a whole number of hundredths")
    return round(100 * similarity)


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """nodes(node), edges(a, b) -> (node, root): root is the least node of the component; nodes without edges are left out.

    Alternates large-star and small-star steps: every step keeps the components and moves edges towards the least node,
    until each component is a star; each round is cut with checkpoint(), and only a sum comes to the driver.
    """
    def sums(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.where("b < a")
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = near.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("m").alias("a"), "b")
        else:
            out = joined.select(F.col("m").alias("a"), "b").unionAll(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
        return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    before = sums(edges)
    for _ in range(rounds):
        edges = star(star(edges, True), False).checkpoint()
        now = sums(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def roots_of(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """classes(fp, first), edges(a, b) between fingerprints -> fp, first, root."""
    roots = components(classes.select(F.col("fp").alias("node")), edges)
    return classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = 3) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable).

    Exact copies collapse to their fingerprint before anything is paired, so a group of copies costs one row. Ids meet
    their component in a join that Spark may split where one fingerprint has many documents.
    """
    fps = fingerprints(docs).checkpoint()
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first")).checkpoint()
    of = roots_of(classes, links(classes.select("fp"), distance))
    ids = of.groupBy("root").agg(F.min("first").alias("component_id"))
    named = of.join(ids, "root").select(F.col("fp").alias("c_fp"), "component_id").checkpoint()
    return fps.join(named, fps["fp"] == named["c_fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, distance: int = 3, similarity: float | None = None) -> DataFrame:
    """docs with one row of each component of linked texts: that of the least doc_id (null last), then of the least row hash.

    Rows are decided one by one, whatever their ids: rows of one id, or without an id, whose texts differ are different
    documents; of rows that are equal in all columns one stays. With a similarity, texts that `similar_roots` finds are linked too.
    A row is known by its id and its hash, so copies spread over all tasks. Columns of type map don't enter the hash.
    """
    plain = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, T.MapType)]
    rows = docs.select(row_of(docs).alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.xxhash64(*plain).alias("h"))
    every = (sketches(rows, False) if similarity is None else sketches(rows, True, percent_of(similarity))).checkpoint()
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("h").alias("h"))
    classes = every.groupBy("fp").agg(F.min(rank).alias("first")).checkpoint()
    edges = links(classes.select("fp"), distance)
    of = roots_of(classes, edges) if similarity is None else similar_roots(rows, every, classes, edges, similarity)
    least = of.groupBy("root").agg(F.min("first").alias("least"))
    stay = least.join(every.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")), F.col("least.id").eqNullSafe(F.col("doc_id")) & (F.col("least.h") == F.col("h")))
    stay = settled(stay.select(F.col("doc_id").alias("s_id"), F.col("h").alias("s_h"), "n"), "near-kept")
    left = rows.join(small(stay), F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_h"))).select("row", "doc_id", "h", "n")
    if stay.where("n > 1").limit(1).count() == 0:
        return left.select("row.*")
    once = left.where("n > 1").dropDuplicates(["doc_id", "h"])
    return left.where("n = 1").unionAll(once).select("row.*")
