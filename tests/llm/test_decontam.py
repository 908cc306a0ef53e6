"""Contamination against a brute-force version that looks at every pair of places."""

import random
import re

from pyspark.sql import functions as F

from axlewatch.llm import decontam

W = decontam.WINDOW


def raw(text):
    text = "".join(c for c in text or "" if c.isalnum() or c.isspace())
    return text.split()


def template(words, names):
    out = []
    for w in words:
        unit = out and out[-1].endswith("<num>") and w in decontam.UNITS.split()
        out.append("<unit>" if unit else re.sub(r"[0-9]+", "<num>", w))
    if names:
        out = [t if t == "<unit>" else re.sub(r"[A-ZÄÖÜÉ][a-zäöüé]+", "<name>", t) for t in out]
    return [t.lower() for t in out]


def judged(doc, item, mode):
    """(share, consistent) of the best alignment that passes, or None."""
    if mode == decontam.VERBATIM:
        d, v = ([x.lower() for x in raw(t)] for t in (doc, item))
        td, ti, size = d, v, min(W, len(v))
    else:
        d, v = raw(doc), raw(item)
        if mode == decontam.LOWER:
            d, v = [x.lower() for x in d], [x.lower() for x in v]
        td, ti, size = template(d, mode == decontam.NAMES), template(v, mode == decontam.NAMES), W
    if not size:
        return None
    wins = {i: tuple(ti[i : i + size]) for i in range(len(ti) - size + 1)}
    if mode != decontam.VERBATIM:
        wins = {i: w for i, w in wins.items() if sum("<" not in t for t in w) >= 2}
    hits = [(p, i) for p in range(len(td) - size + 1) for i, w in wins.items() if tuple(td[p : p + size]) == w]
    groups, shifts = [], sorted({p - i for p, i in hits})
    groups += [{s} for s in shifts]
    for s in shifts:
        if groups[len(shifts) :] and s - max(groups[-1]) <= decontam.NEARBY:
            groups[-1].add(s)
        else:
            groups.append({s})
    best = None
    for g in groups:
        inside = [(p, i) for p, i in hits if p - i in g]
        share = len({wins[i] for _, i in inside}) / len(set(wins.values()))
        if share < 0.8:
            continue
        met = {(v[i + k], p + k) for p, i in inside for k in range(size) if mode != decontam.VERBATIM and "<" in ti[i + k]}
        pairs = {(a, d[q]) for a, q in met}
        ok = []
        for a in {a for a, _ in met}:
            bs = {b for x, b in pairs if x == a}
            most = max(len({x for x, y in pairs if y == b}) for b in bs)
            if len({q for x, q in met if x == a}) > 1 or len(bs) > 1 or most > 1:
                ok.append(len(bs) == 1 and most == 1)
        consistent = sum(ok) / len(ok) if ok else 1.0
        places, same = len({q for _, q in met}), len({q for a, q in met if d[q] == a})
        if consistent >= 0.8 or same >= 0.8 * places:
            best = max(best or 0, share)
    return best


def brute(docs, items):
    out = {}
    for item_id, item in items:
        modes = [decontam.NAMES, decontam.LOWER]
        known = [m for m in modes if any(sum("<" not in t for t in w) >= 2 for w in (lambda t: [t[i : i + W] for i in range(len(t) - W + 1)])(template(raw(item) if m == decontam.NAMES else [x.lower() for x in raw(item)], m == decontam.NAMES)))]
        for doc_id, doc in docs:
            shares = [x for m in known or [decontam.VERBATIM] if (x := judged(doc, item, m)) is not None]
            if shares:
                out[doc_id, item_id] = round(max(shares), 6)
    return out


def test_against_brute_force(spark):
    r = random.Random(11)
    names, things, units = ["Anna", "Bert", "Cora", "Dirk", "Emma", "Fred"], ["pears", "coins", "books", "tiles", "ropes"], ["kg", "hours", "km"]

    def question():
        a, b = r.sample(names, 2)
        x, y, z = (r.randrange(2, 99) for _ in range(3))
        t, u = r.choice(things), r.choice(units)
        return f"{a} owns {x} {t} and gives {y} {u} of them to {b} before {a} and {b} share {z} more {t} with {x} friends. How many {t} does {r.choice([a, b])} own in the end?"

    items = [(i, question()) for i in range(6)] + [(20, "Too short"), (21, "one"), (22, None), (23, "Anna 12 Bert 13 Cora 14 Dirk"), (24, "Emma 5 kg 7")]
    docs = []
    for i in range(160):
        q = r.choice(items[:6])[1] if i % 3 else question()
        if r.random() < 0.5:
            m = dict(zip(names, r.choices(names, k=6) if r.random() < 0.5 else r.sample(names, 6)))
            q = " ".join(m.get(w, str(int(w) + i % 4) if w.isdigit() else w) for w in q.split())
        q = r.choice([str, str.upper, str.lower, lambda s: s.replace(" and ", " and also "), lambda s: s[: len(s) * 5 // 6], lambda s: s.replace(" ", " \n ", 3)])(q)
        docs.append((i, " ".join([r.choice(["Well then", "so", ""]), q, r.choice(["", question(), "that is too SHORT for one", "anna 12 bert 13 cora 14 dirk!", "Emma 5 kg 7", "Emma 6 kg 7"])])))
    docs += [(900, None), (901, "")]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(x.doc_id, x.item_id): round(x.share, 6) for x in got} == want
    assert len({i for _, i in want}) >= 9 and len(want) > 100 and len(want) < len(docs) * 6


def test_values_must_correspond_one_to_one(spark):
    item = "When Anna has 12 pears and Bert has 30 pears then how many pears do Anna and Bert have if both of them eat 4 pears"
    docs = [(1, item.replace("Anna", "Cora").replace("Bert", "Dirk").replace("12", "7")), (2, item.replace("Anna", "Cora").replace("Bert", "Cora")), (3, item.replace("Anna has", "Cora has").replace("Bert has", "Emma has").replace("30", "9"))]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [x.doc_id for x in got] == [1]


def test_rows_decide_by_id_and_text_and_columns_clash(spark):
    item = "When Anna has 12 pears and Bert has 30 pears then how many pears do Anna and Bert have if both of them eat 4 pears"
    docs = spark.createDataFrame([(None, item), (None, "clean text"), (1, "clean text"), (1, item), (2, None)], "doc_id long, text string")
    for c in ("row", "bad_id", "hash", "pos", "mode", "item_id", "_w", "_h", "shift", "n", "slots"):
        docs = docs.withColumn(c, F.lit("own"))
    items = spark.createDataFrame([(7, item)], "item_id long, text string").withColumn("hash", F.lit(1)).withColumn("_v", F.lit(1))
    out = decontam.without_contaminated(docs, items)
    assert out.columns == docs.columns
    assert sorted(((x.doc_id or 0), x.text or "") for x in out.collect()) == [(0, "clean text"), (1, "clean text"), (2, "")]
    assert decontam.without_contaminated(docs, items.limit(0)).count() == 5 and decontam.without_contaminated(docs.limit(0), items).count() == 0
