"""Fingerprints and components against plain Python over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from marketloom.llm import simhash_gray as S
from llm_rows import clashing, docs


def plain_fp(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def plain_components(fps):
    """Least id reachable, by testing every pair."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and (fps[x] ^ fps[y]).bit_count() <= 4:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: find(i) for i in ids}


def texts():
    rnd = random.Random(5)
    vocab = [f"w{k}" for k in range(400)]
    out = []
    for k in range(60):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 30, 300]))]
        out.append(" ".join(base))
        for _ in range(rnd.choice([0, 1, 6])):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = "changed"
            out.append("  ".join(copy).upper() if rnd.random() < 0.3 else "\n".join(copy))
    return [*out, "", None, " \t\n", "one", "ONE", "É é four words", "x " * 30_000]


def test_fingerprints_and_components_equal_all_pairs(spark):
    rows = list(enumerate(texts()))
    random.Random(1).shuffle(rows)
    df = clashing(docs(spark, rows), ["fp", "rep", "component", "block", "rank", "id"])
    got = {r.doc_id: r for r in S.near_duplicates(df).collect()}
    fps = {i: plain_fp(t) for i, t in rows}
    assert {i: r.fp % 2**64 for i, r in got.items()} == fps
    assert {i: r.component for i, r in got.items()} == plain_components(fps)


def test_null_ids_repeated_rows_and_no_rows(spark):
    rows = [(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (3, None)]
    got = sorted(map(tuple, S.near_duplicates(docs(spark, rows)).select("doc_id", "component").collect()), key=str)
    assert got == sorted([(7, 7), (7, 7), (None, None), (3, 3)], key=str)
    empty = S.near_duplicates(docs(spark, [(1, "x")]).where("doc_id < 0"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "fp", "component"]


@pytest.mark.parametrize("chunk", [16, 1 << 15])
def test_search_over_cut_runs_finds_every_component(spark, chunk):
    """A hot ball of fingerprints, long chains and random ones, in chunks that cut the runs."""
    rnd = random.Random(9)
    fps = {rnd.getrandbits(64) for _ in range(300)}
    center = rnd.getrandbits(64)
    for _ in range(250):
        x = center
        for k in rnd.sample(range(64), rnd.randrange(7)):
            x ^= 1 << k
        fps.add(x)
    x = rnd.getrandbits(64)
    for _ in range(40):
        for k in rnd.sample(range(64), 4):
            x ^= 1 << k
        fps.add(x)
    rows = dict(enumerate(fps))
    signed = [(v - 2**64 if v >> 63 else v, k) for k, v in rows.items()]
    pairs = S.near_pairs(spark.createDataFrame(signed, "fp long, rep long"), 4, chunk)
    for a, b in pairs.collect():
        assert a != b
    want = plain_components(rows)
    comp = {r.id: r.component for r in S.components(pairs).collect()}
    assert {k: comp.get(k, k) for k in rows} == want


def test_gray_rank_is_the_inverse_of_the_gray_code():
    x = np.random.default_rng(0).integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2)
    assert (S.gray_rank(x ^ (x >> np.uint64(1))) == x).all()


def test_few_links_go_through_few_tasks(spark, monkeypatch):
    written, durable = [], S.durable

    def counted(df):
        written.append(durable(df))
        return written[-1]

    links = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(300)] + [(7, 7)]
    monkeypatch.setattr(S, "durable", counted)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 32)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(links, "a long, b long")
        found = {few: sorted(map(tuple, S.components(frame).collect())) for few in (S.FEW, 0) if not monkeypatch.setattr(S, "FEW", few)}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    least = [(i, 0) for i in range(1, 301)] + [(i, 1000) for i in range(1001, 1300)]
    assert found[0] == least and all(f == least for f in found.values())
    # The rounds of the first run come before those that go through all partitions.
    assert len(written) % 2 == 0
    first = written[1 : len(written) // 2]
    assert first and max(len(df.inputFiles()) for df in first) <= S.TASKS
