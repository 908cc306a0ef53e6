"""Repeated passages and lines against brute force, and rows of one id, of none, or with clashing columns."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from axlewatch.llm import substring

SCHEMA = "doc_id long, text string"
VOCAB = [a + b for a in "ba ce di fo gu hy ké LA mo nu".split() for b in "st rn lp x qu ff".split()]


def words_of(text):
    return [m.group().lower() for m in substring.WORD.finditer(text or "")]


def prose(r, n):
    return " ".join(r.choice(VOCAB) + str(r.randrange(40)) for _ in range(n))


def brute(docs, length):
    """Words (doc, place) in a run of `length` words that stands earlier, too. docs in rank order."""
    seen, out = set(), collections.defaultdict(set)
    for d, (_, text) in enumerate(docs):
        w = words_of(text)
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if key in seen:
                out[d].update(range(i, i + length))
            seen.add(key)
    return out


def removed_words(docs, rows):
    at = {i: d for d, (i, _) in enumerate(docs)}
    out = collections.defaultdict(set)
    for r in rows:
        spans = [m.span() for m in substring.WORD.finditer(docs[at[r.doc_id]][1])]
        inside = [k for k, (a, b) in enumerate(spans) if a >= r.start_char and b <= r.end_char]
        assert spans[inside[0]][0] == r.start_char and spans[inside[-1]][1] == r.end_char and len(inside) == r.n_words
        out[at[r.doc_id]].update(inside)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_against_brute_force(spark, seed):
    r = random.Random(seed)
    passages = [prose(r, n) for n in (20, 21, 25, 33, 50, 51, 80, 120)] + [prose(r, 30).upper()]
    docs = []
    for i in range(60):
        parts = [prose(r, r.randrange(0, 40)) for _ in range(3)]
        for p in r.sample(passages, r.randrange(0, 3)):
            parts.insert(r.randrange(len(parts) + 1), p if r.random() < 0.7 else p.replace(" ", r.choice(["\n", "  ", "\t"])))
        docs.append((i, r.choice([" ", "\n"]).join(parts)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, ("same line again\n" * 30)), (103, "x " * 200), (104, docs[5][1][: len(docs[5][1]) // 2])]
    got = removed_words(docs, substring.repeated_passages(spark.createDataFrame(docs, SCHEMA), 20, 20).collect())
    must, may = brute(docs, 20), brute(docs, substring.RUN)
    assert sum(map(len, must.values())) > 500
    for d in range(len(docs)):
        assert must[d] <= got[d] <= may[d], d


def test_every_repeated_line_goes_by_default(spark):
    docs = [(1, "One Line here.\nfirst"), (2, "one  line here.\nsecond\n\n \nlast"), (3, "third\nONE LINE HERE.\nlast")]
    df = spark.createDataFrame(docs, SCHEMA)
    got = {(r.doc_id, docs[r.doc_id - 1][1][r.start_char : r.end_char], r.n_words, r.n_units, r.kept_doc_id) for r in substring.repeated_passages(df).collect()}
    assert got == {(2, "one  line here.", 3, 1, 1), (3, "ONE LINE HERE.\nlast", 4, 2, 1)}
    assert {r.doc_id: r.text for r in substring.without_repeats(df).collect()} == {1: docs[0][1], 2: "\nsecond\n\n \nlast", 3: "third\n"}
    assert substring.repeated_passages(df, min_line_words=4).count() == 0


def test_passage_is_exact_to_the_word_and_keeps_offsets(spark):
    r = random.Random(9)
    p = prose(r, 27)
    docs = [(5, "Ünder " + prose(r, 13) + " " + p + " " + prose(r, 11)), (2, "\u00e9\u00e9 " + p.upper() + " , tail"), (9, prose(r, 30) + "\n" + p.replace(" ", "\n"))]
    df = spark.createDataFrame(docs, SCHEMA)
    got = {x.doc_id: x for x in substring.repeated_passages(df, 20, 20).collect()}
    text = dict(docs)
    assert {i: (text[i][x.start_char : x.end_char].lower().split(), x.kept_doc_id) for i, x in got.items()} == {i: (p.lower().split(), 2) for i in (5, 9)}
    cut = {x.doc_id: x for x in substring.without_repeats(df, 20, 20).collect()}
    for i, x in cut.items():
        (a, z), = x.removed or [(0, 0)]
        assert x.text == text[i][:a] + text[i][z:]


def test_rows_decide_by_id_and_text(spark):
    r = random.Random(3)
    p, other = prose(r, 60), prose(r, 40)
    docs = [(1, p), (None, p), (None, "UNIQUE " + other), (1, p), (1, other + " more"), (4, None), (4, "")]
    df = spark.createDataFrame(docs, SCHEMA)
    got = substring.without_repeats(df, 20, 20).collect()
    assert len(got) == len(docs)
    count = collections.Counter((x.doc_id, x.text) for x in got)
    assert count[1, p] == 2 and count[None, ""] == 1 and count[4, None] == 1
    assert count[1, other + " more"] == 1 and count[None, "UNIQUE "] == 1  # an id ranks before none


def test_odd_tables(spark):
    names = ["spans", "removed", "t", "row", "s_id", "at", "h", "n", "words", "k", "pos", "side", "start_char", "n_words"]
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t "), (None, "Ein wort. " * 4000), (5, "x" * 100000)], SCHEMA)
    for c in names:
        df = df.withColumn(c, F.lit("own"))
    out = substring.without_repeats(df)
    assert sorted(out.columns) == sorted(df.columns)
    rows = {x.doc_id: x for x in out.collect()}
    assert rows[1].text is None and rows[3].text == " \n\t " and rows[5].text == "x" * 100000 and rows[5].spans == "own"
    assert len(re.findall(r"\S+", rows[None].text)) < 30
    assert substring.without_repeats(df.limit(0)).count() == 0
