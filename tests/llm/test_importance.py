"""Importance resampling against a version that hashes each n-gram by itself."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from axlewatch.llm import importance


def features(text, buckets):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, percent, min_words, buckets):
    s, t = [0] * buckets, [0] * buckets
    own = [features(x, buckets) for _, x in docs]
    for f in own:
        for b in f[1]:
            s[b] += 1
    for x in target:
        for b in features(x, buckets)[1]:
            t[b] += 1
    big_s, big_t = sum(s) + buckets, sum(t) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in range(buckets)]
    out = []
    for (i, _), (n, f) in zip(docs, own, strict=True):
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def got(spark, docs, target, percent=30, min_words=2, buckets=50):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for c in ("bucket", "n", "score", "weight", "rank", "_row", "n_words"):
        df = df.withColumn(c, F.lit("own"))
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    return sorted((tuple(r) for r in importance.resampled(df, goal, percent, min_words, 42, buckets).collect()), key=str)


def corpus(n):
    rng = random.Random(n)
    words = ["The", "cat", "é", "x1", "9", "größe", "TWO"]
    return [(i, rng.choice([" ", "-", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(n)]


def test_equals_features_hashed_one_by_one(spark):
    docs = corpus(80) + [(None, "the cat"), (None, None), (500, ""), (501, "..."), (7, "the cat sat"), (7, "the cat sat"), (502, "w " * 5000 + "ñ" * 3000)]
    target = ["the cat", None, "größe two 9"]
    assert got(spark, docs, target) == brute(docs, target, 30, 2, 50)


def test_blocks_and_slices_change_nothing(monkeypatch):
    texts = pa.array([t for _, t in corpus(40)] + [None, "a b c d e f g h"])
    monkeypatch.setattr(importance, "BLOCK", 7)
    counts = np.zeros((len(texts), 97), np.int64)
    for bucket, row in importance.grams(texts, 97):
        np.add.at(counts, (row, bucket), 1)
    want = np.zeros_like(counts)
    for i, t in enumerate(texts.to_pylist()):
        for b in features(t, 97)[1]:
            want[i, b] += 1
    assert np.array_equal(counts, want)
    monkeypatch.setattr(importance, "SLICE", 50)
    assert [len(t) for _, t in importance.slices(texts)] != [len(texts)] and sum(len(t) for _, t in importance.slices(texts)) == len(texts)


def test_empty_tables(spark):
    assert got(spark, [], ["x"]) == []
    docs = corpus(20)
    assert got(spark, docs, []) == brute(docs, [], 30, 2, 50)
