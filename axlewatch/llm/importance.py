"""Importance resampling towards a target: hashed n-gram features, a gain for each bucket, Gumbel noise, the highest scores.

Features are counted with Arrow kernels: texts are lower-cased, split and flattened, words become dictionary indices, and
shifted indices form pairs and triples. A triple is a pair of (pair, word), so only distinct pairs get a CRC, which is
combined from those of its two parts; gains are taken by bucket and summed over each document's segment. The corpus is
read twice: once for the counts of the buckets (a vector of fixed length from each task), once for the weights.

Defined results: a null or empty text, or one without words, has no features and weight 0; a null doc_id hashes as an
empty one and ties last; repeated rows are drawn one by one; with an empty target all its counts are 0; an empty table
gives an empty result. A very long text is taken in blocks of words.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axlewatch.llm.common import settled
from axlewatch.operators.ranked import running_sums

#: What stands between words, once A-Z are lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, LONGEST = 10_000, 3
#: Bytes of text that the kernels take at once, and words for which n-grams are formed at once.
SLICE, BLOCK = 1 << 22, 1 << 20


@functools.lru_cache(maxsize=1 << 12)
def shift_tables(n: int) -> np.ndarray:
    """The linear map that a CRC undergoes when n bytes follow, as a table for each of its four bytes."""
    zeros = bytes(n)
    none = zlib.crc32(zeros)
    table = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        place, of = divmod(bit, 8)
        values = np.arange(256)
        table[place, (values >> of) & 1 == 1] ^= np.uint32(zlib.crc32(zeros, 1 << bit) ^ none)
    return table


def joined_crc(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs of texts put together, from the CRCs of their parts and the second part's length in bytes."""
    if not len(first):
        return first
    distinct, at = np.unique(lengths, return_inverse=True)
    tables = np.stack([shift_tables(int(n)) for n in distinct])
    out = second.copy()
    for place in range(4):
        out ^= tables[at, place, (first >> np.uint32(8 * place)) & np.uint32(255)]
    return out


def encoded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the index of each code among the distinct ones, the distinct codes)."""
    d = pa.array(codes).dictionary_encode()
    return d.indices.to_numpy(), d.dictionary.to_numpy()


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of about SLICE bytes each; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > SLICE:
            yield start, texts.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(texts) > start:
        yield start, texts.slice(start)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the row of each."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=BREAK)
    words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(words, "")
    return words.filter(real), rows.filter(real).to_numpy().astype(np.int64)


def grams(texts: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of every run of 1 to 3 words, in blocks; rows ascend inside each array."""
    words, rows = words_of(texts)
    for a in range(0, len(words), BLOCK):
        part = words.slice(a, BLOCK + LONGEST - 1).dictionary_encode()
        own, row, i = min(BLOCK, len(words) - a), rows[a : a + BLOCK + LONGEST - 1], part.indices.to_numpy().astype(np.int64)
        distinct = part.dictionary.cast(pa.binary()).to_pylist()
        n_words = len(distinct)
        crc = np.fromiter(map(zlib.crc32, distinct), np.uint32, n_words)
        tail = np.fromiter((zlib.crc32(w, SPACE) for w in distinct), np.uint32, n_words)
        length = np.fromiter(map(len, distinct), np.int64, n_words) + 1
        yield crc[i[:own]] % buckets, row[:own]
        held, code = crc, i
        for k in range(1, LONGEST):
            same = row[: len(row) - k] == row[k:]
            same[: len(same)] &= code[: len(same)] >= 0
            index, pairs = encoded(code[: len(same)][same] * n_words + i[k:][same])
            left, right = np.divmod(pairs, n_words)
            held = joined_crc(held[left], tail[right], length[right])
            code = np.full(len(same), -1, np.int64)
            code[same] = index
            here = code[:own]
            yield held[here[here >= 0]] % buckets, row[: len(here)][here >= 0]


#: The CRC of a space, with which every later word of a run begins.
SPACE = zlib.crc32(b" ")


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """docs(text) -> bucket, n: features in each bucket that has any. A task gives at most a row for each bucket."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                for bucket, _ in grams(texts, buckets):
                    n += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(each, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * log of the smoothed ratio of target to corpus) for each bucket: a vector of fixed length."""
    s, t = ({r.bucket: r.n for r in bucket_counts(df, buckets).collect()} for df in (docs, target))  # at most a row for each bucket
    all_s, all_t = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    return np.array([math.floor(1000 * math.log((t.get(b, 0) + 1.0) * all_s / ((s.get(b, 0) + 1.0) * all_t))) for b in range(buckets)], np.int64)


def weights(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_features, weight: the sum of the gains of a document's features."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, texts in slices(batch.column(1)):
                for kind, (bucket, row) in enumerate(grams(texts, len(gains))):
                    ends = np.searchsorted(row, np.arange(len(texts) + 1))
                    sums = np.concatenate([[0], np.cumsum(gains[bucket])])[ends]
                    here, count = slice(first, first + len(texts)), np.diff(ends)
                    features[here] += count
                    weight[here] += np.diff(sums)
                    if kind % LONGEST == 0:
                        n[here] += count
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    out = [docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]]
    return docs.select("doc_id", "text").mapInArrow(each, T.StructType(out))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """docs(doc_id, text), target(text) -> doc_id, n_features, weight, score, rank (null: not drawn).

    Of the documents of at least min_words words, `percent` of a hundred with the highest scores are drawn without
    replacement: Gumbel noise, seeded and keyed by doc_id, is added to the weight.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = settled(weights(docs, bucket_gains(docs, target, buckets)).withColumn("score", F.col("weight") + noise).withColumn("_row", F.monotonically_increasing_id()), "importance")
    able = scored.where(F.col("n_words") >= min_words)
    draws = able.count() * percent // 100
    placed = running_sums(able.withColumns({"_down": -F.col("score"), "_none": F.col("doc_id").isNull()}), ["_down", "_none", "doc_id", "_row"], {"rank": F.lit(1).cast("long")})
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = placed.select(*columns, F.when(F.col("rank") <= draws, F.col("rank")).alias("rank"))
    return drawn.unionAll(scored.where(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("long")))
