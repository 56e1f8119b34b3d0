"""Counts of all prefixes against the tokenizers library."""

import random

import pytest

from marketloom.llm import prefix_tokens as P
from llm_rows import clashing, docs, vocabulary  # noqa: F401

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    "Plain WORDS, and don't we'll it's 12345!!", "", None, " \n\t ", "thonerbleing ciónmente überßlich Straße",
    "<|endoftext|>a<|startoftext|>!!<|endof", "ÀÉ café Å İstanbul ΣΑΣ ς", "漢字仮名 交じり文　全角 nb\xa0sp \x1c \x85",
    "x" * 300, "!?!?'s'ven't", "word​zero", "🎉👍🏽 emoji",
]


def test_every_prefix_equals_the_library(vocabulary):
    own = P.Model(vocabulary("word_bpe_49k.json"))
    for text in TEXTS:
        total, changes = 0, memoryview(own.changes(text or "")).cast("b")
        assert len(changes) == len(text or "")
        for k, step in enumerate(changes, 1):
            total += step
            assert total == own.count(text[:k]), text[:k]


def test_random_words_and_texts(vocabulary):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    own = P.Model(vocabulary("word_bpe_49k.json"))
    alphabet = st.sampled_from(list("abcdefghijklmnopqrstuvwxyzthethe'sóéñ,.!19 \n<|>É"))

    @settings(max_examples=500, deadline=None)
    @given(st.text(alphabet, max_size=30))
    def check(text):
        total = 0
        for k, step in enumerate(memoryview(own.changes(text)).cast("b"), 1):
            total += step
            assert total == own.count(text[:k]), text[:k]

    check()


def test_texts_that_are_not_composed(vocabulary):
    """Prefixes of decomposed letters, Hangul and mixed runs; a long run takes linear time."""
    from hypothesis import given, settings
    from hypothesis import strategies as st

    own = P.Model(vocabulary("word_bpe_49k.json"))
    marks = ["e\u0301", "\u0301", "\u0323", "o", "'", "ll", "ve", "S", "!", "7", "\u1112\u1161\u11ab", "\u1161",
             "\u0f73", "\u212b", "\u09c7\u09be", "İ", "Σ", "\xa0", " ", "漢", "<|"]

    @settings(max_examples=600, deadline=None)
    @given(st.lists(st.sampled_from(marks), max_size=40).map("".join))
    def check(text):
        total = 0
        for k, step in enumerate(memoryview(own.changes(text)).cast("b"), 1):
            total += step
            assert total == own.count(text[:k]), text[:k]

    check()
    calls = []
    own.count, count = lambda t: calls.append(len(t)) or count(t), own.count
    for unit in ("e\u0301", "e\u0301'!", "x\u0323\u0301-"):
        long = unit * 8000
        assert sum(memoryview(own.changes(long)).cast("b")) == count(long)
    assert calls == [16000, 32000, 32000]  # the whole run once, to compare


def test_operator_and_questions(spark, vocabulary):
    path = vocabulary("word_bpe_49k.json")
    long = " ".join(random.Random(1).choice(["thing", "Überbau", "don't"]) for _ in range(20_000))
    rows = [*enumerate([*TEXTS, long]), (2, "again"), (None, "no id")]
    df = clashing(docs(spark, rows), ["n_bytes", "n_tokens", "changes", "over_limit"])
    counts = P.over_limit(P.prefix_counts(df, path), 2048)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in counts.collect())
    count = P.Model(path).count
    want = sorted((i is None, i or 0, len((t or "").encode()), count(t or ""), count(t or "") > 2048) for i, t in rows)
    assert got == want
    asked = {r.doc_id: r for r in P.answers(counts.where("n_bytes < 400"), [0, 7, 9999], [0, 3]).collect()}
    for i, t in [r for r in rows[: len(TEXTS)] if r[0] != 2]:
        t = t or ""
        assert (asked[i].at_0, asked[i].at_9999) == (0, count(t))
        if t:
            assert asked[i].at_7 == count(t[:7])
            assert asked[i].fit_3 == max(k for k in range(len(t) + 1) if count(t[:k]) <= 3)
    assert P.prefix_counts(df.where("doc_id > 99"), path).count() == 0
