"""Text operators against brute force, round trips, and odd rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash

from axlewatch.llm import chat, decontam, mixing, quality, rules, secret_scan, simhash, tokens, warc

TOK = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, None, "en", "a"), (2, "", "en", None), (3, "word", None, "b"), (3, "word", None, "b"), (None, "Ein wort. " * 4000, "de", "a"), (4, "a b\nc  d\t e", "en", "a"), (5, "x" * 100000, "en", "a")]
SCHEMA = "doc_id long, text string, lang string, source string"
WORDS = "the of and to in is it that was for on are with as his they be at one have this from or had by hot but some what there we can out other were all your when".split()


def sentence(i, n=30):
    r = np.random.default_rng(i)
    return " ".join(WORDS[k] + str(r.integers(50)) for k in r.integers(0, len(WORDS), n)) + "."


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, SCHEMA).withColumns({"size": F.lit(1), "row": F.lit("r"), "fp": F.lit(2), "key": F.lit("k")})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")


def test_chat_round_trip_with_hostile_texts(spark):
    texts = ["\\### Assistant: </turn> ok", '</turn>\n<turn role="x" loss>', "\\l \\\\ \\", None, "<image:0:5>", "é\n"]
    rows = [(1, i, "assistant" if i % 2 else 'us"er\n', t) for i, t in enumerate(texts)] + [(None, None, None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.text_parts(df))).collect()}
    want = "".join(f"{r[2]}\n{r[3] or ''}\n" for r in rows[:6])
    loss = "".join(r[3] or "" for r in rows[:6] if r[2] == "assistant")
    assert got[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[None].n_turns == 2
    assert chat.read_back(chat.format_turns(chat.text_parts(df.limit(0)))).count() == 0


def test_chat_parts_become_numbered_placeholders():
    text, found = chat.PartVisitor().visit([{"text": "</"}, {"text": "turn>"}, {"type": "image", "ref": "i.png", "width": 56, "height": 28}, {"type": "audio", "ref": "a", "seconds": 1.0}, {"type": "document", "ref": "d", "pages": 2}, {"text": "end"}])
    assert text == "\\l/turn><image:0:3><audio:1:25><document:2:516>end"
    assert [(a["ref"], a["tokens"]) for a in found] == [("i.png", 3), ("a", 25), ("d", 516)]
    assert chat.unescape(chat.escape("</turn>\\l<image")) == "</turn>\\l<image"


def test_loser_tree_merges():
    runs = [[(k, k) for k in r] for r in ([1, 4, 9], [], [2, 2, 8], [0], [5, 6])]
    assert list(warc.LoserTree(runs)) == [0, 1, 2, 2, 4, 5, 6, 8, 9]
    assert list(warc.LoserTree([])) == []


def test_warc_index_is_ordered_and_complete(spark):
    pages = [(i, f"http://www.h{i % 3}.org:80/p{i % 7}?b=2&a=1", f"<p>{i % 5}</p>") for i in range(40)] + [(40, None, None), (41, "", ""), (None, "x", "<p>0</p>"), (0, "http://www.h0.org:80/p0?b=2&a=1", "<p>0</p>")]
    got = warc.capture_index(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert collections.Counter((r.page_id, r.payload_digest) for r in got) == collections.Counter((i, sha(h)) for i, _, h in pages)
    want = collections.Counter((i, len((h or "").encode()), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in pages)
    assert collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == want
    order = [(r.url_key, r.timestamp, r.page_id is None, r.page_id or 0) for r in got]
    assert order == sorted(order)
    assert warc.url_key("http://www.H0.org:80/p?b=2&a=1#f") == "org,h0)/p?a=1&b=2"


@pytest.mark.parametrize(("fan", "rows"), [(256, 1000), (2, 3)])
def test_runs_merge_in_passes_and_small_groups(spark, monkeypatch, fan, rows):
    monkeypatch.setattr(warc, "FAN", fan)
    monkeypatch.setattr(warc, "GROUP_ROWS", rows)
    pages = [(i * 7919 % 500, f"http://h{i % 2 and i % 11}.org/p{i % 5}", f"{i}") for i in range(500)] + [(None, "http://h0.org/p0", "x"), (None, "", None)]
    got = warc.capture_index(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7)).collect()
    assert len(got) == len(pages) and [warc.order(r.asDict()) for r in got] == sorted(warc.order(r.asDict()) for r in got)
    assert warc.capture_index(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_ranges_get_the_row_groups_that_they_meet(spark):
    r = random.Random(7)
    key = lambda: (r.choice("abcdefgh"), str(r.randint(0, 3)), r.random() < 0.1, r.randint(0, 2))
    runs = {f"r{i}": sorted(key() for _ in range(r.randint(1, 40))) for i in range(20)}
    rows = [(n, g, k[g * 3][0], k[g * 3][1], None if k[g * 3][2] else k[g * 3][3]) for n, k in runs.items() for g in range(-(-len(k) // 3))]
    groups = spark.createDataFrame(rows, "run string, place int, url_key string, timestamp string, page_id long")
    cuts = sorted({key() for _ in range(9)})
    got = {(x.run, x.job): set(x.places) for x in warc.met_ranges(groups, cuts).collect()}
    for name, keys in runs.items():
        for at, k in enumerate(keys):
            assert at // 3 in got[name, sum(c <= k for c in cuts)]
    assert len(got) < len(runs) * (len(cuts) + 1)  # a run isn't opened for ranges that it doesn't reach
    assert {(x.run, x.job) for x in warc.met_ranges(groups, []).collect()} == {(n, 0) for n in runs}


def test_chat_ties_unknown_parts_and_null_roles(spark):
    rows = [(1, 0, None, "a!"), (1, 0, "", "a"), (1, 0, None, None), (1, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = chat.read_back(chat.format_turns(chat.text_parts(df))).first()
    assert got.turns_sha256 == hashlib.sha256(b"user\nfirst\n\n\n\na\n\na!\n").hexdigest()
    text, found = chat.PartVisitor().visit([{"type": "video", "ref": "v"}, None, {"text": "<other"}])
    assert (text, found) == ("<other:0:0>\\lother", [{"n": 0, "type": "video", "ref": "v", "tokens": 0}])


def test_mix_takes_any_column_names_and_rows_of_one_id_one_by_one(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(None, sentence(i, 10), "s") for i in range(30)] + [(1, sentence(99, 10), "t")] * 2, "doc_id long, text string, source string")
    for c in ("target", "whole", "source_size", "last_key", "row", "size", "key", "bin", "times", "p_source", "copy", "need"):
        docs = docs.withColumn(c, F.lit("own"))
    assert mixing.mix(docs).columns == docs.columns
    got = [r for r in mixing.mix_sizes(docs, (1, 1), 1.25).collect() if r.doc_id is None]
    assert {r.taken for r in got} == {10, 20} and abs(sum(r.taken for r in got) - got[0].target) <= 10


def test_mix_reaches_targets(spark, odd):
    docs = spark.createDataFrame([(i, sentence(i, 5 + i % 40), "s" + str(i % 4) if i % 9 else None) for i in range(400)], "doc_id long, text string, source string")
    got = mixing.mix_sizes(docs).collect()
    assert sorted(got) == sorted(mixing.mix_sizes(docs.repartition(7)).collect())
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    src = {r.doc_id: r.source for r in docs.collect()}
    for r in got:
        by[src[r.doc_id]][0] += r.taken
        by[src[r.doc_id]][1] += r.size
        by[src[r.doc_id]][2] = r.target
        assert r.taken <= 2 * r.size
    total = sum(v[1] for v in by.values())
    assert abs(sum(v[2] for v in by.values()) - 1.5 * total) < 1e-6 * total
    assert all(abs(v[0] - v[2]) <= 45 and v[2] <= 2 * v[1] + 1e-9 for v in by.values())
    assert mixing.mix_sizes(odd).count() == len(ODD) and mixing.mix(odd).columns == odd.columns
    assert mixing.mix_sizes(odd.limit(0)).count() == 0


def test_token_files_round_trip(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOK)
    docs = ODD + [(10 + i, x, "en", "a") for i, x in enumerate([" a  b", "it's 5.5, über\tz", "\n", "a b c d.", "two  spaces", "tail "])]
    got = tokens.tokenized(spark.createDataFrame(docs, SCHEMA), TOK).collect()
    want, at = [], 0
    for i, x in sorted(((d[0], d[1]) for d in docs), key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = t.encode(x or "", add_special_tokens=False).ids + [tokens.END_ID]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    assert tokens.tokenized(odd.limit(0), TOK).count() == 0


def test_encoder_equals_the_library_in_any_batch():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(TOK), tokens.Encoder(TOK)
    texts = [sentence(i, 40).replace("1", "é,").replace("2", "\n") for i in range(50)]
    ids, n = e.encode(pa.array(texts))
    assert ids.tolist() == [k for x in texts for k in [*t.encode(x, add_special_tokens=False).ids, tokens.END_ID]]


def test_decontamination_finds_reparameterised_items(spark, odd):
    item = "When Alice has 12 apples and gives 5 kg of them to Robert then how many apples does Alice still have in total after that"
    other = item.replace("Alice", "Maria").replace("Robert", "Peter").replace("12", "90").replace("5", "7")
    mixed = item.replace("Alice has", "Maria has").replace("does Alice", "does Peter").replace("Robert", "Olga").replace("12", "90").replace("apples does", "apples does")
    docs = [(1, "x y. " + item + " z"), (2, "so it goes " + other + "!!"), (3, sentence(1, 60)), (4, item[:40]), (5, mixed)]
    items = spark.createDataFrame([(7, item), (8, "too short"), (9, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert {(1, 7), (2, 7)} <= set(got) and not {(3, 7), (4, 7)} & set(got)
    assert got[1, 7].changed == 0 and got[2, 7].changed >= 3
    assert (5, 7) not in got
    assert decontam.contaminated(odd, items).count() == 0
    assert decontam.without_contaminated(odd, items).count() == len(ODD)


def test_decontamination_finds_changed_case_and_spaced_units(spark):
    item = "When Alice has 12 apples and gives 5 kg of them to Robert then Alice asks Maria how many apples Robert and Peter still have"
    docs = [(1, "So " + item.upper()), (2, item.lower()), (3, item.replace("5 kg", "5\n kg").upper()), (4, item.replace("Alice", "Olga").upper())]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.share, r.changed) for r in got) == [(1, 1.0, 0), (2, 1.0, 0), (3, 1.0, 0)]


def test_decontamination_checks_each_alignment(spark):
    item = "When Alice has 12 apples and gives 5 kg of them to Robert then how many apples does Alice still have in total after that"
    bad = [item.replace("Alice has", f"{x} has").replace("12", str(i)).replace("5", str(i + 60)).replace("Robert", y) for i, (x, y) in enumerate([("Maria", "Olga"), ("Peter", "Ines"), ("Clara", "Emil"), ("Hugo", "Lena"), ("Paula", "Karl"), ("Rita", "Otto")], 20)]
    bad = [t.replace("does Alice", "does Bruno") for t in bad]
    docs = [(1, " . ".join([*bad, item])), (2, " . ".join(bad))]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [r.doc_id for r in got] == [1]


def test_quality_learns_and_defines_odd_rows(spark, odd, labels):
    docs = spark.createDataFrame([(i, sentence(i, 60) if i % 4 else sentence(i, 60).replace(" ", "### ")) for i in range(400)], "doc_id long, text string")
    got = quality.quality_scores(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert held and all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in got)
    good, bad = [r.score for r in held if r.doc_id % 4], [r.score for r in held if not r.doc_id % 4]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    out = quality.quality_scores(odd, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(odd, labels).select("row.*").columns == odd.columns


def slow_fingerprint(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark, odd):
    base = [sentence(i, 400) for i in range(30)]
    texts = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.replace("the", "The", 3) + " x") for i, t in enumerate(base)] + [(200, base[0]), (201, base[0]), (300, None), (301, ""), (302, " \t"), (303, "one"), (304, "one Two"), (305, "ÉA b c")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    fp = {i: slow_fingerprint(t) for i, t in texts}
    root = {i: i for i, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in fp:
        for j in fp:
            if i < j and (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (f"{fp[i]:016x}", find(i)) for i, _ in texts}
    kept = simhash.without_near_duplicates(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i, _ in texts})
    assert simhash.near_duplicates(odd).count() == len(ODD) and simhash.near_duplicates(odd.limit(0)).count() == 0
    assert simhash.without_near_duplicates(odd).columns == odd.columns


def test_pipeline_drops_near_copies_beyond_three_bits(spark, odd):
    import corpus_pipeline

    base = [sentence(i, 120) for i in range(8)]
    edited = [" ".join("edited" if k in (20, 80) else w for k, w in enumerate(t.split())) for t in base]  # Jaccard 106 / 126
    far = [" ".join("far" if k % 12 == 0 else w for k, w in enumerate(t.split())) for t in base]  # under 0.8
    assert any((slow_fingerprint(a) ^ slow_fingerprint(b)).bit_count() > 3 for a, b in zip(base, edited, strict=True))
    texts = [(i, t) for i, t in enumerate(base + edited + far)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(texts, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [*range(8), *range(16, 24)]
    assert corpus_pipeline.near_dedup(spark, odd, "").columns == odd.columns and corpus_pipeline.near_dedup(spark, odd.limit(0), "").count() == 0


def test_rules_against_brute_force(spark, odd, labels):
    texts = [(i, ("a b c d e f g " * (i % 5) + sentence(i, 20 + i)) + "\nline\nline\n \n \n#$|") for i in range(40)]
    df = spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in rules.quality_rules(df, labels).collect()}
    for i, t in texts:
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) for j in range(5) if c[tuple(w[k : k + 5])] > 1}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
    assert rules.quality_rules(odd, labels).count() == len(ODD) and rules.quality_rules(odd.limit(0), labels.limit(0)).count() == 0


def test_binomial_bound(spark):
    from math import comb

    from pyspark.sql import functions as F

    cases = [(0, 50), (1, 50), (3, 400), (20, 1000)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", rules.binomial_at_most(F.col("k"), F.col("n"), 0.02).alias("p")).collect()
    for r in got:
        assert abs(r.p - sum(comb(r.n, i) * 0.02**i * 0.98 ** (r.n - i) for i in range(r.k + 1))) < 1e-9


def test_secrets_of_odd_rows(spark, odd):
    assert secret_scan.secret_spans(odd).count() == len(ODD)
    assert {r.base_sha256 for r in secret_scan.secret_spans(odd).collect()} == {hashlib.sha256(b"").hexdigest()}
    assert secret_scan.secret_spans(odd.limit(0)).count() == 0


def test_pipeline_keeps_columns_and_decisions(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
