"""Texts made to break hashes, and texts made to take long."""

import re
import time

import numpy as np
import pytest

from gleaner.llm import decontaminate, ngram_join, secret_scan
from gleaner.llm.bytewords import ALNUM, NOT_SPACE, Words
from gleaner.llm.scratch import Scratch


def thue_morse(bits):
    word = "a"
    for _ in range(bits):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


T, C = thue_morse(11)


def test_different_words_are_not_one(spark):
    """Words that every polynomial in an odd base modulo 2**64 takes for one."""
    rows = [(1, f"{T} {T} {T} x y"), (2, f"{C} {C} {C} x y"), (3, f"{C} {C} {C} x y"), (4, f"k {C} z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark, frame, buckets=1 << 14).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4}
    bench = spark.createDataFrame([(1, T), (2, "x y")], "item_id long, text string")
    found = {r["doc_id"]: (list(r["items"]), [tuple(s) for s in r["spans"]]) for r in decontaminate.find_contamination(spark, frame, bench).collect()}
    assert found == {1: (["1", "2"], [(0, 5)]), 2: (["2"], [(3, 5)]), 3: (["2"], [(3, 5)]), 4: ([], [])}


def test_words_with_one_hash_are_compared(monkeypatch):
    """Even where all hashes of a length agree, only equal words get a symbol."""
    phrases = decontaminate.Phrases([("1", "alpha gamma"), ("2", "beta")], 10)
    words = Words([b"alpha omega beta beto gamma"], ALNUM, phrases.seed)
    right = phrases.symbols(words).tolist()
    assert right[1] == right[3] == 0 and len({right[0], right[2], right[4]}) == 3
    words.hashes[1], words.hashes[3] = words.hashes[0], words.hashes[2]
    assert phrases.symbols(words).tolist() == right


@pytest.mark.parametrize("rule,pattern", [(NOT_SPACE, rb"[^\x20\x09-\x0D]+"), (ALNUM, rb"[0-9a-z\x80-\xff]+")])
def test_hashes_follow_words(rule, pattern):
    rng = np.random.default_rng(2)
    docs = [bytes(rng.choice(np.frombuffer(b"abAB \t\n.0\xc3\xa9", np.uint8), n)) for n in (0, 1, 7, 8, 9, 200, 3000)] + [b"q" * 5000, b"Q" * 5000 + b" " + b"q" * 64 + b" " + b"q" * 65]
    words = Words(docs, rule, 7)
    found = [re.findall(pattern, d.lower()) for d in docs]
    assert np.diff(words.begin).tolist() == [len(f) for f in found]
    by_word = {}
    for w, h in zip([w for f in found for w in f], words.hashes.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word) > 100
    assert (Words(docs, rule, 8).hashes != words.hashes).all()


def test_scans_are_linear():
    rules = [(k, re.compile(p), g, n) for kinds in secret_scan.RULES.values() for k, (p, g, n) in kinds.items()]
    began = time.time()
    for unit in ("eyJ", "eyJaaaaaaaaaa.", "token", "AKIA", "0a", "-----BEGIN ", "a://", "a:", "password "):
        secret_scan.find_secrets(unit * (5_000_000 // len(unit)), rules)
    assert time.time() - began < 60
    token = "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 15
    assert secret_scan.find_secrets(f"x {token} y", rules) == [("web_token", 2, 2 + len(token))]


def test_redaction_of_many_secrets(spark):
    text = "token=abcdef01 " * 100_000
    frame = spark.createDataFrame([(1, text, "a"), (1, "token=zzzzzzzz", "b"), (None, "token=zzzzzzzz", "c"), (2, None, "d"), (1, text, "a")], "doc_id long, text string, _found string")
    found = secret_scan.scan_secrets(spark, frame, Scratch(spark, "t").path("ledger")).persist()
    found.count()
    began = time.time()
    got = secret_scan.redact(frame, found)
    rows = sorted(map(tuple, got.collect()), key=str)
    assert time.time() - began < 30 and got.columns == frame.columns
    assert rows == sorted([(1, "[secret] " * 100_000, "a")] * 2 + [(1, "[secret]", "b"), (None, "[secret]", "c"), (2, None, "d")], key=str)
