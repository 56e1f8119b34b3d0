"""Counts against plain Python, decoding against all labellings, verdicts on clear cases."""

import itertools
import random
import re

import numpy as np

from marketloom.llm import crf_quality as C
from llm_rows import clashing, docs

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {
        p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 8)
    }
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(inside),
        len(words) < 20 or 100 * len(inside) > 30 * len(words),
    )


def prose(rnd, n):
    words = [rnd.choice(["the", "ab", "naïve", "thing", "over", "lies"]) + str(k % 7) for k in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, n, 12))


def junk(rnd, n):
    return "\n".join(" ".join(f"{rnd.choice('abcdef')}{k}***" for k in range(10)) for _ in range(n // 10))


def table(rnd):
    rows = []
    for i in range(300):
        rows.append((i, prose(rnd, 60) if i % 3 else junk(rnd, 60)))
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "few words"), (904, "a b c d e f g h i " * 30)]
    rows += [(905, "\xa0one\x1ctwo three " * 8 + "\n\n<x>"), (906, prose(rnd, 20_000)), (None, prose(rnd, 30)), (1, prose(rnd, 30))]
    return rows


def test_counts_and_verdicts(spark):
    rnd = random.Random(4)
    rows = table(rnd)
    df = clashing(docs(spark, rows), ["n_words", "kept", "label", "features", "quality"])
    labels = spark.createDataFrame(
        [(i, int(i % 3 > 0), 0) for i in range(200)] + [(None, 1, 0), (5, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int"
    )
    field = C.fit_on_labels(df, labels)
    got = C.judge(df, field).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        if len(t or "") < 5000:
            assert any(tuple(r)[1:7] == plain_counts(t) for r in by[i]), i
    for i in range(200, 300):
        assert by[i][0].kept == (i % 3 > 0)
    assert [by[i][0].kept for i in (900, 901, 902, 903, 904)] == [False] * 5
    kept = C.keep(df, field)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    none = df.where("doc_id > 9999")
    assert C.judge(none, C.fit_on_labels(none, labels)).count() == 0


def test_without_labels_all_lines_are_content(spark):
    field = C.fit([], [])
    assert field.decode(np.ones((3, len(C.FEATURES)))).tolist() == [1, 1, 1]


def test_decoding_finds_the_best_labelling():
    rnd = np.random.default_rng(3)
    for _ in range(30):
        n = int(rnd.integers(1, 7))
        field = C.Field(rnd.normal(size=(len(C.FEATURES), 2)), rnd.normal(size=(2, 2)))
        x = rnd.normal(size=(n, len(C.FEATURES)))
        scores = x @ field.emission

        def value(y):
            return sum(scores[i, k] for i, k in enumerate(y)) + sum(field.transition[a, b] for a, b in zip(y, y[1:]))

        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert field.decode(x).tolist() == list(best)


def test_fit_climbs_the_likelihood():
    good = [np.eye(1, len(C.FEATURES)).repeat(4, 0) for _ in range(20)]
    bad = [x.copy() for x in good]
    for x in bad:
        x[:, 1] = 1.0
    field = C.fit(good + bad, [1] * 20 + [0] * 20)
    assert field.decode(good[0]).tolist() == [1] * 4
    assert field.decode(bad[0]).tolist() == [0] * 4
    mixed = np.concatenate([good[0], bad[0]])
    assert 0 in field.decode(mixed) and 1 in field.decode(mixed)


def test_late_lines_train(spark):
    """Poor documents that differ from good ones only behind their first hundred lines."""
    rnd = random.Random(12)
    calm = lambda n: "\n".join(prose(rnd, 12) for _ in range(n))
    late = lambda: "\n".join(f"##|| 7{k}" for k in range(60))
    rows = [(i, calm(100) + "\n" + (late() if i % 2 else calm(60))) for i in range(20)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(20)], "doc_id long, quality int")
    field = C.fit_on_labels(docs(spark, rows), labels)
    assert len(C._sequence(rows[1][1].encode())[0]) == 160
    assert field.decode(C._sequence(late().encode())[0]).mean() == 0
    assert field.decode(C._sequence(rows[0][1].encode())[0]).mean() > 0.9
