"""Copies whose words a leak has made common, against brute force over all stretches."""

import random

import numpy as np
from llm_rows import docs

from marketloom.llm import latent_decontam as L


def changed(rnd, words, share):
    """The words with at most ``share`` of them replaced, left out or doubled by others."""
    out = list(words)
    for k in rnd.sample(range(len(words)), int(share * len(words) + 1e-9)):
        out[k] = rnd.choice([f"new{rnd.randrange(10**6)}", "", f"{words[k]} new{rnd.randrange(10**6)}"])
    return " ".join(out).split()


def test_copies_in_a_third_of_all_documents(spark):
    """Exact and 20%-changed copies of short items between rare words: all are found, nothing else."""
    rnd = random.Random(21)
    rare = lambda n: [f"rare{rnd.randrange(10**6)}" for _ in range(n)]
    items = {k: [f"item{k}word{j}" for j in range(m)] for k, m in enumerate([5, 8, 15, 17, 20, 40, 59])}
    rows, want = [], set()
    for i in range(420):
        parts = rare(40)
        if i % 3 == 0:
            for k, words in items.items():
                parts += (words if i % 2 else changed(rnd, words, 0.2)) + rare(40)
                want.add((i, k))
        rows.append((i, " ".join(parts)))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    df = docs(spark, rows)
    found = L.find_leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert all(r.share >= L.COPY_SHARE for r in found)
    assert {r.doc_id for r in L.without_leaks(df, bench).select("doc_id").collect()} == {i for i in range(420) if i % 3}


def test_no_stretch_with_enough_of_a_passage_is_lost():
    rnd = random.Random(8)
    vocab = [f"w{k}" for k in range(60)]
    passages = [(k, [rnd.choice(vocab) for _ in range(rnd.randrange(5, 14))], ["w0"]) for k in range(12)]
    index = {w: i for i, w in enumerate(sorted({w for _, p, _ in passages for w in p}))}
    idf = np.array([rnd.random() for _ in index])
    s = L.Searcher(passages, index, idf, 1.0, np.eye(len(index)))
    texts = [[]]
    for k in range(40):
        copy = [w for w in passages[k % 12][1] for w in ([w, "out"] if rnd.random() < 0.4 else [w] if rnd.random() < 0.8 else ["out"])]
        noise = [rnd.choice([*vocab, "out"]) for _ in range(rnd.randrange(0, 30))]
        at = rnd.randrange(len(noise) + 1)
        texts.append(noise[:at] + copy + noise[at:])
    n = 0
    for least in (0.6, 0.8):
        found = list(s.called(s._encode(texts), least))
        for d, words in enumerate(texts):
            for p, (_, passage, _) in enumerate(passages):
                size = L.STRETCH * len(passage)
                for a in range(max(1, len(words) - size + 1)):
                    stretch = words[a : a + size]
                    if L.common_subsequence(passage, stretch) >= least * len(passage):
                        n += 1
                        hits = [x for x in found if x[0] == d and x[3] == p]
                        assert any(L.common_subsequence(passage, words[x[1] : x[2]]) >= least * len(passage) for x in hits)
                        shown = [j for j in range(a, a + len(stretch)) if words[j] in passage]
                        assert any(x[1] <= shown[0] and shown[-1] < x[2] for x in hits)
    assert n > 100


def test_benchmark_is_read_by_blocks_of_items_not_by_partitions(spark):
    items = [(k, " ".join(f"item{k}word{j}" for j in range(9))) for k in range(7)]
    bench = spark.createDataFrame([*items, items[2], (None, "no id here at all"), (9, None)], "item_id long, text string")
    df = docs(spark, [(i, f"before {text} after") for i, text in items] + [(50, "clean text of some words")])
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sc = spark.sparkContext
    try:
        sc.setJobGroup("blocks of the benchmark", "")
        found = list(L.searchers(df, bench))
        jobs = len(sc.statusTracker().getJobIdsForGroup("blocks of the benchmark"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    assert [i for s in found for i, _, _ in s.passages] == list(range(7)) and jobs < 40
    small = [i for s in L.searchers(df, bench, block=2) for i, _, _ in s.passages]
    assert small == list(range(7))
    assert {r.doc_id for r in L.without_leaks(df, bench, block=3).collect()} == {50}
