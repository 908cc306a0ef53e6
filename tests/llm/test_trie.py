"""Prefix trie against a dictionary of prefixes, and tree contraction against sums from the leaves up."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from axlewatch.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in conv.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
    members, kids = defaultdict(list), defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids[s]) if kids[s] else 1
        saved[s] = (len(members[s]) - 1) * (len(s[-1][1]) if s else 0) + sum(saved[k] for k in kids[s])
    return sorted(
        (min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), leaves[s], saved[s], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(s)))).encode()).hexdigest())
        for s, m in members.items()
    )


def got(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    for c in ("c", "d", "k", "r", "h", "key", "digest", "base", "_row"):
        df = df.withColumn(c, F.lit("own"))
    return sorted(tuple(r) for r in trie.prefix_trie(df).collect())


def test_trie_equals_a_dictionary_of_prefixes(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 30), *range(100, 112), 207, 300]:
        for t in range(rng.randint(1, 8)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "è" * 3])))
    rows += [(5, 2, "user", "tie"), (5, 2, "user", "tie"), (5, None, "user", "first"), (None, 0, "user", "lost"), (7, 50, None, "x" * 200_000)]
    assert got(spark, rows) == brute(rows)


def test_turnless_conversations_and_no_rows(spark):
    absent = next(c for c in range(401, 500) if trie_h(c) >= 2)
    rows = [(absent, 0, "user", "only")]
    assert got(spark, rows) == brute(rows) == [(absent, 0, None, 1, 0, 1, 0, hashlib.sha256(str(absent).encode()).hexdigest())]
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []


def trie_h(c):
    return zlib.crc32(str(c).encode()) % 6


def test_one_long_conversation_and_many_copies(spark):
    rows = [(0, t, "user", f"t{t % 3}") for t in range(150)] + [(c, t, "user", f"same{t}") for c in range(600, 640) for t in range(8)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize(("n", "chain"), [(1, 0.0), (40, 0.0), (200, 0.9), (150, 1.0)])
def test_contraction_recovers_every_subtree_total(spark, n, chain):
    rng = random.Random(n)
    nodes = [(0, 0, None, None)]
    for i in range(1, n):
        p = nodes[-1] if rng.random() < chain else rng.choice(nodes)
        nodes.append((i, p[1] + 1, p[0], p[1]))
    value = {x[0]: rng.randint(0, 9) for x in nodes}
    total = dict(value)
    for x in reversed(nodes):
        if x[2] is not None:
            total[x[2]] += total[x[0]]
    df = spark.createDataFrame([(*x, value[x[0]], 1) for x in nodes], "c long, d long, pc long, pd long, v long, one long")
    rows = trie.subtree_totals(df, ["v", "one"]).collect()
    assert {r.c: r.v for r in rows} == total and len(rows) == n
    assert next(r.one for r in rows if r.c == 0) == n
