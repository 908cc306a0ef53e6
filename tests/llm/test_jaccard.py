"""Jaccard components against all pairs; the bounds of the tree against exact counts."""

import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from axlewatch.llm import jaccard


def shingles(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")))
    return {" ".join(w[i : i + k]) for i in range(max(len(w) - k + 1, min(len(w), 1)))}


def brute(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.7:
            w = rng.choice(texts[-8:]).split()
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
            texts.append(" ".join(w) or "w")
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 12, 25, 60, 150, 400]))))
    return list(enumerate(texts))


def got(spark, rows, percent=90):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in ("n", "node", "h", "root", "tree", "block", "rep"):
        df = df.withColumn(c, F.lit("own"))
    return sorted((tuple(r) for r in jaccard.jaccard_components(df, percent).collect()), key=str)


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 20), (2, 4000), (3, 500)])
def test_components_equal_all_pairs_whatever_the_block(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", block)
    rows = corpus(seed)
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(3, None), (4, ""), (5, " \n"), (6, "one"), (7, "ONE"), (8, "one two"), (9, "one  two"), (9, "one two"), (None, "one two"), (None, "alone here now"), (1, long), (2, long + " end"), (11, "É a b"), (12, "é a b")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_a_large_group_of_near_copies_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 8000)
    base = [f"b{i}" for i in range(100)]
    rng = random.Random(9)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(1 if i % 2 else 3):
            w[rng.randrange(100)] = f"n{i}"
        rows.append((i, " ".join(w)))
    assert got(spark, rows) == brute(rows)


def test_keys_meet_for_every_linked_pair():
    rng, t = np.random.default_rng(4), jaccard.Threshold(90)
    for _ in range(400):
        n = int(rng.integers(10, 400))
        a = np.unique(rng.integers(1 << 63, size=n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.03], rng.integers(1 << 63, size=int(rng.integers(0, 1 + n // 20)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not np.array_equal(a, b) and 100 * both >= 90 * (len(a) + len(b) - both):
            assert set(jaccard.keys(a, t)) & set(jaccard.keys(b, t))
            assert both >= t.shared(len(a), len(b)) and len(a) + len(b) - 2 * both <= t.differ(len(a), len(b))


@pytest.mark.parametrize("percent", [80, 90])
def test_keys_meet_in_any_order_of_tokens(percent):
    rng, t = np.random.default_rng(5), jaccard.Threshold(percent)
    met = 0
    for _ in range(400):
        n, tokens = int(rng.integers(1, 300)), rng.integers(1 << 63, size=400, dtype=np.uint64) * np.uint64(2)
        a, b = (np.unique(tokens[:n][rng.random(n) > 0.04]) for _ in "ab")
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            marks = rng.integers(1, 256, size=1 << jaccard.CELL_BITS, dtype=np.uint8) if n % 2 else np.ones(1 << jaccard.CELL_BITS, np.uint8)
            assert set(jaccard.keys(a, t, marks)) & set(jaccard.keys(b, t, marks))
            assert len(jaccard.keys(a, t, marks)) <= (100 - percent) * len(a) // 100 + 1
            met += 1
    assert met > 100


def test_a_passage_that_all_texts_hold_brings_no_texts_into_a_tree(spark, monkeypatch):
    passage, moved, real = [f"c{i}" for i in range(60)], [], jaccard.blocks_of
    rows = [(k, " ".join([*(f"d{k}w{i}" for i in range(90)), *passage])) for k in range(60)]
    rows.append((60, rows[0][1] + " end"))
    monkeypatch.setattr(jaccard, "blocks_of", lambda sets: (moved.append(sets.count()), real(sets))[1])
    assert got(spark, rows) == brute(rows) and moved == [2]


def test_texts_that_share_keys_but_cannot_link_share_no_tree(spark, monkeypatch):
    """Half of each text's words are those of all others, or it is three times as long; with one order of tokens by hash, they share keys."""
    passage, moved, real = [f"c{i}" for i in range(60)], [], jaccard.blocks_of
    rows = [(k, " ".join([*(f"d{k}w{i}" for i in range(60 if k % 2 else 400)), *passage])) for k in range(20)]
    rows.append((20, rows[0][1] + " end"))
    monkeypatch.setattr(jaccard, "token_marks", lambda docs, words: np.ones(1 << jaccard.CELL_BITS, np.uint8))
    monkeypatch.setattr(jaccard, "blocks_of", lambda sets: (moved.append(sets.count()), real(sets))[1])
    t = jaccard.Threshold(90)
    held = [set(jaccard.keys(jaccard.shingles(x, 3), t)) for _, x in rows]
    assert sum(bool(a & b) for a in held for b in held) > 100
    assert got(spark, rows) == brute(rows) and moved == [2]


@pytest.mark.parametrize("crowd", [0, 3])
def test_components_equal_all_pairs_where_keys_are_crowded(spark, monkeypatch, crowd):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "token_marks", lambda docs, words: np.ones(1 << jaccard.CELL_BITS, np.uint8))
    rows = corpus(6)
    assert got(spark, rows) == brute(rows)


def test_bitmaps_of_any_widths_bound_what_two_sets_share(monkeypatch):
    rng = np.random.default_rng(8)
    for widest in (1 << 17, 256):
        monkeypatch.setattr(jaccard, "MAP_BITS", widest)
        for _ in range(300):
            tokens = rng.integers(1 << 63, size=int(rng.integers(1, 900)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            a, b = (np.unique(np.append(tokens[rng.random(len(tokens)) < rng.random()], tokens[:1])) for _ in "ab")
            most = jaccard.most_shared(jaccard.map_of(a), jaccard.map_of(b), len(a), len(b))
            assert len(np.intersect1d(a, b)) <= most <= min(len(a), len(b))


def test_a_block_of_many_short_sets_needs_no_bitmap_for_each(monkeypatch):
    """20,000 sets of 6 tokens and one of 5000 are a block: a bitmap as wide as the block's for each is 164 MB."""
    rng = np.random.default_rng(10)
    sets = [np.unique(rng.integers(1 << 63, size=6, dtype=np.uint64) * np.uint64(2)) for _ in range(20_000)]
    sets.append(np.unique(rng.integers(1 << 63, size=5000, dtype=np.uint64) * np.uint64(2)))
    few = [sets[0], sets[5], sets[-1]]
    m = jaccard.Members([b"%d" % k for k in range(3)], np.array([len(s) for s in few]), np.concatenate(few))
    maps = m.bitmaps(jaccard.BLOCK_BITS)
    bitmap, distinct = m.union(jaccard.BLOCK_BITS)
    assert (bitmap == np.bitwise_or.reduce(maps)).all() and (distinct == jaccard.ones(maps)).all()
    m = jaccard.Members([b"%d" % k for k in range(len(sets))], np.array([len(s) for s in sets]), np.concatenate(sets))
    tracemalloc.start()
    m.union(jaccard.BLOCK_BITS)
    short = jaccard.Members(m.nodes[-2000:], m.sizes[-2000:], m.tokens[-int(m.sizes[-2000:].sum()) :])
    monkeypatch.setattr(jaccard, "MAPS_BYTES", 1 << 20)
    assert jaccard.linked(short, short, jaccard.Threshold(90), {})[0] == []
    assert tracemalloc.get_traced_memory()[1] < 32 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("percent", [60, 75, 80, 90, 100])
def test_keys_of_parts_meet_for_every_linked_pair(percent):
    """Sets on both sides of a class of sizes and of the few tokens; cells that tell tokens apart and cells that don't."""
    rng, t = np.random.default_rng(11), jaccard.Threshold(percent)
    met = 0
    for k in range(1500):
        n = int(rng.choice([1, 2, 5, 9, 12, 15, 16, 17, 18, 20, 26, 27, 30, 40, 80, 81, 90, 243, 300, 729, 760])) + int(rng.integers(3))
        tokens = rng.integers(1 << 63, size=2 * n, dtype=np.uint64) * np.uint64(2)
        lost, added = (int(rng.integers(0, 1 + (100 - percent) * n // 100)) for _ in "ab")
        a, b = np.unique(tokens[:n]), np.unique(tokens[lost : n + added])
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            marks = rng.integers(1, 256, size=1 << jaccard.CELL_BITS, dtype=np.uint8) if k % 2 else np.ones(1 << jaccard.CELL_BITS, np.uint8)
            one, other = (jaccard.keys_of(x, t, marks, 256) for x in (a, b))
            assert set(one) & set(other) and len(one) <= 2 * (len(a) * (100 - percent) // percent + 2)
            met += 1
    assert met > 400


def test_texts_that_share_runs_of_words_by_chance_share_no_keys(spark, monkeypatch):
    """Texts of a dozen words in any order hold the same runs; keys of single tokens make a pair of nearly each two of them, so pairs grow with their square."""
    rng, made, real = random.Random(12), {}, jaccard.settled
    rows = [(k, " ".join(rng.choice("abcdefghijkl") for _ in range(200))) for k in range(30)]
    rows.append((30, rows[0][1] + " a b"))

    def counted(df, name):
        out = real(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "settled", counted)
    assert got(spark, rows) == brute(rows) and made["jaccard-pairs"] == 1
