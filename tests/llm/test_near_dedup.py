"""Near-dedup of rows: ids that repeat or are missing, ties, clashing columns."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from axlewatch.llm import simhash

A, B, C = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_rows_are_decided_one_by_one(spark, similarity):
    rows = [(1, A), (3, A), (3, B), (None, A), (None, C), (None, C + " c60")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.text) for r in simhash.without_near_duplicates(df, similarity=similarity).collect())
    want = {(1, A): 1, (3, B): 1}
    assert {k: v for k, v in got.items() if not k[1].startswith(C)} == want
    rest = [k for k in got if k[1].startswith(C)]
    assert len(rest) == (1 if similarity else len(rest)) and rest


def test_equal_rows_and_clashing_columns(spark):
    rows = [(i % 3, A if i % 2 else B) for i in range(40)] + [(9, None), (9, None), (8, ""), (7, "one two"), (6, "One  two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("row", "h", "fp", "key", "bands", "n", "s_id", "s_h", "first", "least", "root", "node", "rep"):
        df = df.withColumn(c, F.lit("own"))
    for similarity in (None, 0.8):
        for parts in (1, 5):
            got = simhash.without_near_duplicates(df.repartition(parts), similarity=similarity)
            assert got.columns == df.columns
            assert sorted((r.doc_id, r.text or "") for r in got.collect()) == [(0, A), (0, B), (6, "One  two"), (8, "")]


def test_a_group_is_named_by_its_least_id_whatever_the_text(spark):
    df = spark.createDataFrame([(5, A), (2, A + " x"), (4, A)], "doc_id long, text string")
    assert [r.doc_id for r in simhash.without_near_duplicates(df, similarity=0.8).collect()] == [2]
    assert simhash.without_near_duplicates(df.limit(0), similarity=0.8).count() == 0


def brute_force(rows: list[tuple[int, str]]) -> list[int]:
    """Ids that stay: the least of each component of texts within 3 bits or with 80 % of their shingles in common, by all pairs."""
    sets = {i: set(simhash.shingles(t).tolist()) for i, t in rows}
    fps = {i: simhash.fingerprint(t) & (1 << 64) - 1 for i, t in rows}
    root = {i: i for i, _ in rows}
    for i, j in itertools.combinations(sorted(root), 2):
        both = len(sets[i] & sets[j])
        if (fps[i] ^ fps[j]).bit_count() <= 3 or both and both >= 0.8 * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return sorted(set(root.values()))


@pytest.mark.parametrize("most", [simhash.BROADCAST_ROWS, -1])
def test_kept_rows_equal_brute_force(spark, monkeypatch, most):
    """Families of texts with one to six words changed, so that similarities lie on both sides of 0.8 and buckets hold several components; with bucket tables broadcast and shuffled."""
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", most)
    draw = random.Random(7)
    rows, words = [], [f"w{k}" for k in range(5000)]
    for family in range(40):
        base = draw.choices(words, k=draw.choice((40, 120, 300)))
        for _ in range(draw.choice((1, 2, 4, 12))):
            text = list(base)
            for place in draw.sample(range(len(base)), draw.randint(0, 6)):
                text[place] = draw.choice(words)
            rows.append((len(rows), " ".join(text)))
    draw.shuffle(rows)
    rows += [(len(rows), "three words only"), (len(rows) + 1, "Three words  only")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.without_near_duplicates(df, similarity=0.8).collect()) == brute_force(rows)


def test_members_of_one_bucket_that_only_differ_from_its_centre_still_meet(spark):
    """Four sketches that share one bucket: the one put first resembles none, two others resemble each other."""
    near = " ".join(f"n{k}" for k in range(300))
    rows = [(k, t) for k, t in enumerate([A, B, near, near + " n300"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.col("doc_id"))
    every = simhash.sketches(df, True).withColumn("bands", F.transform("bands", lambda m, k: F.when(k == 0, F.lit(1)).otherwise(F.xxhash64("doc_id", k))))
    every = every.checkpoint()
    classes = every.groupBy("fp").agg(F.min(F.struct(F.lit(False).alias("none"), F.col("doc_id").alias("id"), "h")).alias("first")).checkpoint()
    of = simhash.similar_roots(df, every, classes, spark.createDataFrame([], "a long, b long"), 0.8)
    fps = [simhash.fingerprint(t) for _, t in rows]
    root = {r.fp: r.root for r in of.collect()}
    assert root[fps[2]] == root[fps[3]] and len({root[f] for f in fps}) == 3


def test_no_link_is_lost_in_a_crowded_bucket(spark):
    """Many members that share one key: the only two that resemble each other stand far apart in every order."""
    rng = random.Random(3)
    rows = [(k, " ".join(f"t{k}w{i}" for i in range(60))) for k in range(40)]
    words = [f"n{i}" for i in range(60)]
    rows += [(40, " ".join(words)), (41, " ".join([*words, "n60", "n61"]))]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string").withColumn("h", F.col("doc_id"))
    every = simhash.sketches(df, True).withColumn("bands", F.transform("bands", lambda m, k: F.when(k == 0, F.lit(1)).otherwise(F.xxhash64("doc_id", k)))).checkpoint()
    classes = every.groupBy("fp").agg(F.min(F.struct(F.lit(False).alias("none"), F.col("doc_id").alias("id"), "h")).alias("first")).checkpoint()
    root = {r.fp: r.root for r in simhash.similar_roots(df, every, classes, spark.createDataFrame([], "a long, b long"), 0.8).collect()}
    fps = {k: simhash.fingerprint(t) for k, t in rows}
    assert root[fps[40]] == root[fps[41]] and len(set(root.values())) == 41


def test_texts_that_share_runs_of_words_by_chance_make_few_pairs(spark, monkeypatch):
    """Texts of six words in any order hold some of the same runs of five. Where the cells are full, as of large tables, single tokens as keys make 339 pairs."""
    from axlewatch.llm import jaccard

    rng, made, real = random.Random(13), {}, jaccard.settled
    rows = [(k, " ".join(rng.choice("abcdef") for _ in range(250))) for k in range(30)]
    rows.append((30, rows[0][1] + " a b"))

    def counted(df, name):
        out = real(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "settled", counted)
    monkeypatch.setattr(jaccard, "token_marks", lambda docs, words: np.ones(1 << jaccard.CELL_BITS, np.uint8))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.without_near_duplicates(df, similarity=0.8).collect()) == brute_force(rows)
    assert made["jaccard-pairs"] <= 3
