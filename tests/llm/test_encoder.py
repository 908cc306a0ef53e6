"""The encoder of known pieces gives the same ids as the library on whole texts."""

import json
import random

import public_tokenizers
import pyarrow as pa
import pytest

from axlewatch.llm import tokens

TOK = public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    "", " ", "a", " a", "a ", "a\t b", "x\ty z\t", "a b\n", "it's o'clock 's 't", "a\n\nb c\n", "w. w, w.. w\nx", "a  b", "é. é, ö! <|endoftext|> a",
    "x aé.\nBö, c\r\nd e.\n\nf g\n", "a b.\n.c d,\n, e\n1. ,\n. Ա. z", "a .\nB b b\nB!? x", "B b a b.\nB", "s .\n x y", "1. 2, a1. b_. __. x½. ", "x\x00y z", "😀. 😀 a😀.",
    "one line \nnext line here", "a b \nc d", "a\x00 a a\x00\x00", "a\u00a0 b\u2003\nc\u3000\u3000 d", "\n\u00a0", "a\n\u2003b", "x\x1c y\x1f\nz", "a" * 24 + " " + "a" * 23 + " " + "a" * 300,
]
PARTS = [" ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\u00a0", "\u2003", "\u3000", "\u200b", "\x00", ".", ",", "!?", "'", "'s", "'ll", "-", "a", "B", "é", "Ö", "word", "Word", "12", "½", "😀", "e\u0301", "Ա", "中文", "<|endoftext|>", "<|", "#"]


def same(e, texts):
    ids, counts = e.encode(pa.array(texts, pa.string()))
    want = [[*e.tok.encode(t, add_special_tokens=False).ids, tokens.END_ID] for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("limit", [tokens.CACHE_PIECES, 5])
def test_same_ids(monkeypatch, limit):
    monkeypatch.setattr(tokens, "CACHE_PIECES", limit)
    e = tokens.Encoder(TOK)
    assert e.fits
    for _ in range(3):
        same(e, HARD)
    assert [len(x) for x in e.encode(pa.array([], pa.string()))] == [0, 0]
    same(e, [None or "" for _ in range(3)])


def test_random_texts():
    r, e = random.Random(5), tokens.Encoder(TOK)
    for _ in range(50):
        same(e, ["".join(r.choices(PARTS, k=r.randint(0, 12))) for _ in range(2000)])


def test_a_slice_of_an_array():
    e = tokens.Encoder(TOK)
    ids, counts = e.encode(pa.array(["zero", "one two.", "", "three"]).slice(1, 2))
    assert ids.tolist() == [*e.tok.encode("one two.", add_special_tokens=False).ids, tokens.END_ID, tokens.END_ID] and counts.tolist()[1] == 1


def test_equal_hashes(monkeypatch):
    monkeypatch.setattr(tokens, "mixed", lambda words: words[:, 0] % 3)
    e = tokens.Encoder(TOK)
    for _ in range(2):
        same(e, ["x known words of which many share a hash", "and others with it"])


def test_another_pattern_is_encoded_whole(tmp_path):
    config = json.load(open(TOK, encoding="utf-8"))
    config["pre_tokenizer"] = {"type": "Whitespace"}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(config), encoding="utf-8")
    e = tokens.Encoder(str(other))
    assert not e.fits
    same(e, HARD)


def test_files_are_pruned_by_doc_id(spark, tmp_path):
    path = f"file://{tmp_path}/ids"
    docs = spark.range(0, 20000, 2).selectExpr("id as doc_id", "concat('text number ', id) as text")
    tokens.write_tokens(docs, path, TOK)

    def scanned(ids):
        got = tokens.documents_of(spark, path, ids)
        plan = got._jdf.queryExecution().executedPlan()
        rows = got.collect()
        return [r.doc_id for r in rows], plan.collectLeaves().head().metrics().apply("numOutputRows").value()

    found, read = scanned([5000])
    assert found == [5000] and 0 < read <= 1000  # one row group of one file
    assert scanned([5001]) == ([], 0)  # inside a file's range, but its Bloom filter has no such id
    assert sorted(scanned([2, 19998])[0]) == [2, 19998]


def test_starts_follow_the_files_order(spark, tmp_path):
    path = f"file://{tmp_path}/ids"
    docs = spark.createDataFrame([(7, "a b c d e f"), (7, "x"), (7, "y z"), (3, "q"), (None, None)], "doc_id long, text string")
    tokens.write_tokens(docs, path, TOK)
    stored = [r for r in spark.read.orc(path).orderBy("doc_id", "text_hash").collect()]
    want, at = {}, 0
    for r in stored:
        want[r.doc_id, r.n_tokens] = at
        at += r.n_tokens
    assert {(r.doc_id, r.n_tokens): r.start for r in tokens.read_tokens(spark, path).collect()} == want


def test_a_slice_is_small_enough_for_two_workers_of_an_executor():
    """An executor took 1690 MB with slices of 4 MB and 1281 MB with those of 1 MB (quick runs of the check tool, op5_token_ids)."""
    assert tokens.SLICE_CHARS <= 1 << 20
