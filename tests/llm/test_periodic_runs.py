"""Periodic runs against a search over all stretches."""

import hashlib
import random
import zlib

import pytest

from marketloom.llm import periodic_runs as pr
from marketloom.llm.common import table
from llm_rows import clashing, docs


def brute_runs(words):
    """Every maximal stretch per period, those of a smaller period first."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n_, q) for (s, n_), q in found.items())


def brute_row(doc_id, text, rule):
    words = (text or "").encode().split()
    if rule:
        words = rule(words, doc_id)
    runs = brute_runs(words)
    runs.sort(key=lambda r: (r[0], r[2]))
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join("%d,%d,%d\n" % r for r in runs)
    return (
        len(runs),
        *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(kept).hexdigest(),
    )


def texts(seed, count):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        letters = "abcdefgh"[: rng.choice([1, 2, 2, 3, 8])]
        words = []
        while len(words) < rng.randint(0, 160):
            unit = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 7, 12, 20]))]
            words += unit * rng.choice([1, 1, 2, 4, 5, 9])
            words += words[-rng.randint(1, 5) :] if words and rng.random() < 0.2 else []
        out.append(rng.choice([" ", "\n", " \t"]).join(words))
    return out


@pytest.mark.parametrize("rule", [None, pr.planted])
def test_runs_equal_brute_force(spark, rule):
    rows = list(enumerate(texts(5, 250))) + [(1000, None), (1001, ""), (1002, " \n "), (1003, "a " * 6)]
    got = pr.digest(pr.periodic_runs(docs(spark, rows), rule), rule)
    cells = {r["doc_id"]: tuple(r)[1:] for r in got.collect()}
    assert cells == {i: brute_row(i, t, rule) for i, t in rows}


def test_z_function_is_the_common_beginning():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.randint(0, 1) for _ in range(rng.randint(0, 30))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert pr.z_function(s) == want


def test_rule_follows_the_id():
    words = [b"%d" % i for i in range(50)]
    for doc_id in range(200):
        h = zlib.crc32(str(doc_id).encode())
        got = pr.planted(words, doc_id)
        if h % 10:
            assert got is words
            continue
        a = h // 10 % 50
        p = 1 + (50 - a) // (3 + h // 10 % 8)
        assert got == [words[i] if i < a else words[a + (i - a) % p] for i in range(50)]


def test_odd_rows(spark):
    long = "x y z " * 40_000
    rows = [(None, "a a a a a a a"), (7, "b " * 9), (7, "b " * 9), (7, "c d"), (8, long), (None, None)]
    frame = clashing(docs(spark, rows), ["runs", "_k1", "period", "octave", "words"])
    got = pr.digest(pr.periodic_runs(frame)).select("doc_id", "n_runs", "start", "length", "period").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(None, 1, 0, 7, 1), (7, 1, 0, 9, 1), (7, 1, 0, 9, 1), (7, 0, None, None, None), (8, 1, 0, 120_000, 3), (None, 0, None, None, None)],
        key=str,
    )


def test_empty_table(spark):
    got = pr.digest(pr.periodic_runs(docs(spark, []).limit(0)))
    assert got.count() == 0


def test_whole_table(spark):
    found = table(spark, "/root/testdata/sf0.001", "documents")
    got = pr.digest(pr.periodic_runs(found, pr.planted), pr.planted).collect()
    texts_ = {r["doc_id"]: r["text"] for r in found.collect()}
    assert len(got) == len(texts_)
    for r in got:
        assert tuple(r)[1:] == brute_row(r["doc_id"], texts_[r["doc_id"]], pr.planted)
