"""Cutoffs of the quality rules by a second derivation, and the classifier's risk and gradient by definition."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from axlewatch.llm import quality, rules


def tail(k, n, alpha):
    return sum(math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1))


def level_of(text):
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeat = len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)})
    chars = sum(map(len, words))
    metric = {
        "r_symbols": sum(c in rules.SYMBOLS for c in text) / len(words), "r_repeats": repeat / len(words), "r_lines": (len(lines) - len(set(lines))) / len(lines),
        "r_capitals": sum(c.isupper() for c in text) / chars, "r_word": chars / len(words),
    }
    levels = [next((j for j, cut in enumerate(cuts) if (metric[m] > cut if large else metric[m] < cut)), rules.LEVELS) for m, large, cuts in rules.RULES.values()]
    return min(levels), len(words) < 10 or 100 * repeat > 20 * len(words)


def test_kept_by_a_second_derivation(spark):
    r = random.Random(2)
    docs = []
    for i in range(1500):
        words = [r.choice("lorem ipsum dolor sit amet consectetur adipiscing elit sed do".split()) + str(r.randrange(90)) for _ in range(r.choice([6, 20, 30]))]
        text = " ".join(w + "#" * (r.random() < r.choice([0, 0, 0.02, 0.6])) for w in words)
        docs.append((i, text.upper() if r.random() < 0.01 else text, r.choice(["en", "en", "en", "de", None])))
    labels = [(i, int(r.random() < 0.9), 0) for i in range(1500) if docs[i][2] != "de" or i % 9 == 0] + [(3, 1, 0), (3, 0, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    audit_ids = {x.doc_id for x in df.where(rules.audited(F.col("doc_id"))).collect()}
    good = {i for i, q, _ in labels if q == 1}
    own = {i: level_of(t) for i, t, _ in docs}
    use = [(s, own[i][0]) for i, _, s in docs if i in good and i not in audit_ids and not own[i][1]]
    strata = {s for s, _ in use}
    allowed = {}
    for s in strata:
        at = [lv for x, lv in use if x == s]
        allowed[s] = -1
        for j in range(rules.LEVELS):
            if tail(sum(lv <= j for lv in at), len(at), 0.05) > 0.05 / len(strata):
                break
            allowed[s] = j
    assert len(set(allowed.values())) >= 2 and max(allowed.values()) >= 2
    got = rules.quality_rules(df, lab, alpha=0.05).collect()
    assert {x.doc_id: (x.base_failed, x.level, x.kept) for x in got} == {i: (own[i][1], own[i][0], not own[i][1] and own[i][0] > allowed.get(s, -1)) for i, _, s in docs}
    applied = rules.apply_rules(rules.base_metrics(df), lab, alpha=0.05)
    held = rules.audit(applied, lab).collect()
    assert sum(x.good for x in held) == sum(i in good and i in audit_ids and not own[i][1] for i, _, _ in docs)
    assert all(x.rejected <= 0.05 * x.good + 3 * math.sqrt(0.05 * x.good) for x in held)


def test_guarantee_holds_for_all_rules_together(spark):
    """Of many draws in which each level truly loses more than alpha, hardly any accepts it."""
    rows, alpha = [], 0.1
    r = random.Random(8)
    for s in range(60):
        rows += [(s, 0 if r.random() < 0.12 else rules.LEVELS) for _ in range(200)]
    got = rules.calibrate(spark.createDataFrame(rows, "lang int, level int"), "lang", alpha, 0.05).count()
    assert got <= 1
    fine = [(s, rules.LEVELS) for s in range(3) for _ in range(200)] + [(9, rules.LEVELS)] * 3
    assert {(x.stratum, x.allowed) for x in rules.calibrate(spark.createDataFrame(fine, "lang int, level int"), "lang", alpha, 0.05).collect()} == {(s, rules.LEVELS - 1) for s in range(3)}


@pytest.mark.parametrize("prior", [0.2, 0.9])
def test_risk_and_gradient_by_definition(prior):
    rng = np.random.default_rng(6)
    p, u, w = rng.normal(1, 1, (40, 5)), rng.normal(0, 1, (70, 5)), rng.normal(0, 1, 5)
    loss = lambda z, y: math.log1p(math.exp(-z if y else z))

    def slow(w):
        z = lambda x: sum(a * b for a, b in zip(x, w))
        first = prior * sum(loss(z(x), 1) for x in p) / len(p)
        return first, sum(loss(z(x), 0) for x in u) / len(u) - prior * sum(loss(z(x), 0) for x in p) / len(p)

    pos, neg, g_pos, g_neg = quality.pu_risk(w, p, u, prior)
    assert (pos, neg) == pytest.approx(slow(w))
    for k in range(5):
        up, down = (slow(w + d * 1e-6 * np.eye(5)[k]) for d in (1, -1))
        assert (up[0] - down[0]) / 2e-6 == pytest.approx(g_pos[k], abs=1e-5)
        assert (up[1] - down[1]) / 2e-6 == pytest.approx(g_neg[k], abs=1e-5)


def test_rows_of_one_id_are_one_document_of_the_fit(spark):
    docs = spark.createDataFrame([(i % 7, f"word{i % 3} and more of it {i % 5}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(7)], "doc_id long, quality int")
    scores = [sorted((x.doc_id, x.score) for x in quality.quality_scores(docs.repartition(n), labels, fit_rows=5).collect()) for n in (1, 4)]
    assert scores[0] == scores[1] and len(scores[0]) == 300


@pytest.mark.parametrize("prior", [0.15, 0.5, 0.85])
def test_prior_comes_from_positives_and_unlabelled_rows(prior):
    r = np.random.default_rng(6)
    draw = lambda n, good: r.normal(1.5 if good else -1.5, 1.0, (n, 4))
    unlabelled = np.vstack([draw(int(4000 * prior), True), draw(4000 - int(4000 * prior), False)])
    got = quality.estimated_prior(draw(3000, True), unlabelled[r.permutation(4000)])
    assert abs(got - prior) < 0.06
    assert quality.estimated_prior(draw(30, True), unlabelled) == 0.5


def test_negative_labels_do_not_enter_the_fit(spark):
    good, bad = "The river ran past the mill, and nobody spoke of it again.", "### $$$ buy buy buy %% | | <> click ###"
    docs = spark.createDataFrame([(i, (good if i % 3 else bad) + f" {i % 17} " + "and so on. " * (i % 5)) for i in range(900)], "doc_id long, text string")
    positives = [(i, 1) for i in range(900) if i % 3 and i % 2]
    labelled = [spark.createDataFrame(positives + more, "doc_id long, quality int") for more in ([], [(i, 0) for i in range(900) if i % 3 == 0])]
    a, b = ({r.doc_id: r.score for r in quality.quality_scores(docs, x).collect()} for x in labelled)
    assert a == b
    assert all((a[i] >= 0.5) == bool(i % 3) for i in a)  # held-out documents too
