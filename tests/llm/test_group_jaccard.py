"""The join against all pairs."""

import random

import pyarrow as pa
import pytest

from llm_rows import clashing, docs
from marketloom.llm import group_jaccard as gj
from marketloom.llm import queries
from marketloom.llm.common import table


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k=4, percent=85):
    """rows: (doc_id, text); one answer per row."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None:
                if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
                    continue
                if 100 * len(a & b) >= percent * len(a | b):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least[find(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def answer(frame, **how):
    return sorted(map(tuple, gj.similar_documents(frame, **how).collect()), key=str)


def corpus(seed, groups=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    line = rng.choices(words, k=25)
    texts = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([2, 4, 9, 60, 120]))
        if rng.random() < 0.5:
            base = line + base
        for _ in range(rng.choice([1, 1, 3, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, k, percent", [(1, 4, 85), (2, 5, 80), (3, 1, 50)])
def test_components_equal_all_pairs(spark, seed, k, percent):
    rows = corpus(seed)
    assert answer(docs(spark, rows), shingle=k, percent=percent) == brute(rows, k, percent)


def test_links_between_groups(spark, monkeypatch):
    """Groups of few tokens: links have to be found across them, through hubs and others."""
    monkeypatch.setattr(gj, "GROUP_TOKENS", 300)
    monkeypatch.setattr(gj, "QUERIES", 2)
    monkeypatch.setattr(gj, "SMALL", 10)
    rows = corpus(7, 20)
    # A chain whose ends are not similar.
    chain = [str(1000 + i) for i in range(60)]
    for step in range(12):
        rows.append((5000 - step, " ".join(chain[: 3 * step] and [f"z{i}" for i in range(3 * step)] + chain[3 * step :] or chain)))
    assert answer(docs(spark, rows), shingle=4, percent=85) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (2, "other words in a row with the same id"),
        (2, "A B C D E F"), (3, None), (4, ""), (5, " \n"), (6, "a b"), (7, "A b"), (8, "b a"), (9, "x y " * 60_000),
    ]
    frame = clashing(docs(spark, rows), ["n", "d1", "prefix", "token", "grp", "comp", "component", "id"])
    assert answer(frame, shingle=4, percent=85) == brute(rows)


def test_empty_table(spark):
    assert answer(docs(spark, []).limit(0)) == []


def test_tokens_tell_short_sequences_apart():
    texts = pa.array(["a", "a a", "a a a", "a a a a", "a a a a a", "", "b"])
    sets = gj.token_sets(texts, 4)
    assert [len(s) for s in sets] == [1, 1, 1, 1, 1, 0, 1]
    assert len({s[0] for s in sets if len(s)}) == 5


def test_union_bound_keeps_a_group_shut(monkeypatch):
    import numpy as np

    members = [(i, np.arange(i * 100, i * 100 + 50, dtype=np.uint64), i, False) for i in range(4)]
    group = gj.Group(members)
    counted = []
    monkeypatch.setattr(gj.np, "bincount", lambda *a, **k: counted.append(1) or np.zeros(4, int))
    assert group.similar((9, np.arange(30, 80, dtype=np.uint64), 9, False), 85) == []
    assert not counted


def test_whole_table(spark):
    found = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"]) for r in found.collect()]
    got = queries.queries()["op11_group_jaccard"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_documents_on_one_bit_are_told_apart(spark, monkeypatch):
    """All ids fall on few bits, and ids repeat with other texts: the join sorts them out."""
    monkeypatch.setattr(gj, "MARKS", 16)
    monkeypatch.setattr(gj, "_BITS", 8)
    rows = corpus(11, 12)
    rows += [(i, t) for i, (_, t) in zip(range(0, len(rows), 3), reversed(rows))] + rows[:5]
    assert answer(docs(spark, rows), shingle=4, percent=85) == brute(rows)


def moved(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]


def test_sets_move_once_and_texts_stay(spark, monkeypatch):
    monkeypatch.setitem(gj.__dict__, "_kept", [])
    durable = gj.durable
    monkeypatch.setattr(gj, "durable", lambda df: gj._kept.append(df) or durable(df))
    monkeypatch.setattr(gj, "_sets_of", lambda *a, f=gj._sets_of: gj._kept.append(f(*a)) or gj._kept[-1])
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        gj.similar_documents(docs(spark, corpus(5, 10)), 4, 85).collect()
        held = next(df for df in gj._kept if df.columns == ["token", "id", "n", "room"])
        assert len(moved(held)) == 1
        sets = next(df for df in gj._kept if df.columns == ["id", "tokens"])
        # The sets and the names of the wanted classes, both once.
        plan = sets._jdf.queryExecution().executedPlan().toString()
        assert plan.index("MapInArrow") > plan.index("Exchange") and len(moved(sets)) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
