"""Neighbours against all cosines, scores on held-out rows."""

import random
import zlib

import numpy as np
from llm_rows import clashing, docs

from marketloom.llm import toxic_knn as K


def corpus(rnd):
    calm, rude = [f"calm{k}x" for k in range(200)], ["blorst", "gnashy", "vilefoo", "vilebar", "vilequx"]
    rows, labels = [], []
    for i in range(900):
        words = [rnd.choice(calm) for _ in range(rnd.randrange(20, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rnd.randrange(3, 8)):
                words.insert(rnd.randrange(len(words)), rnd.choice(rude))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "blorst " * 30_000), (None, "gnashy blorst vilefoo"), (5, rows[5][1])]
    labels += [(None, 1, 1), (3, None, None), (7, 0, 0), (5000, 1, 1)]
    return rows, labels


def test_held_out_rows_and_edges(spark):
    rows, labels = corpus(random.Random(3))
    df = clashing(docs(spark, rows), ["label", "score", "term", "terms", "counts", "i", "n"])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    train = K.training_rows(table, "toxic")
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in train.collect())
    index, vectors = K.build(df, train)
    got = K.score_documents(df, index).collect()
    assert sorted(map(str, got)) == sorted(map(str, K.score_vectors(vectors, index).collect()))
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 200
    assert all(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    by = {r.doc_id: r for r in got}
    assert by[2000].score == by[2001].score == index.base < 0.1
    assert by[2002].predicted == 1 and by[None].predicted == 1 and by[None].evidence
    assert all(0 <= r.score <= 1 for r in got)
    none = df.where("doc_id > 9999")
    assert K.score_documents(none, K.build(none, train)[0]).count() == 0
    bare, _ = K.build(df, train.where("label = 0"))
    assert not bare.terms and K.score_documents(df, bare).where("predicted = 1").count() == 0


def test_neighbours_equal_all_cosines():
    rnd = np.random.default_rng(4)
    n, d = 300, 12
    x = rnd.random((n, d)) * (rnd.random((n, d)) < 0.3)
    x[x.sum(1) == 0, 0] = 1.0
    x[10] = x[200]  # a tie
    x /= np.linalg.norm(x, axis=1)[:, None]
    place, term = np.nonzero(x)
    postings = K.Postings(d, n, term, place, x[place, term])
    index = K.Index({}, np.ones(d), postings, np.ones(n), np.zeros(n), np.arange(n), 0.0)
    for _ in range(50):
        places = np.sort(rnd.choice(d, rnd.integers(1, 6), replace=False))
        w = rnd.random(len(places))
        w /= np.linalg.norm(w)
        cosines = x[:, places] @ w
        but = int(rnd.integers(-1, n))
        if but >= 0:
            cosines[but] = 0
        best = index.nearest(np.array([0, len(w)]), places, w, 25, np.array([but]))[0]
        want = sorted(cosines[cosines > 1e-9], reverse=True)[:25]
        assert np.allclose([c for c, _ in best], want, atol=1e-5)
        assert np.allclose([cosines[i] for _, i in best], want, atol=1e-5)


def test_blocks_are_skipped():
    """Examples of ten vocabularies, common and rare terms: few blocks are opened, none is missed."""
    rnd = np.random.default_rng(5)
    n, each = 1000, 60
    x = np.zeros((n, 10 * each))
    for i in range(n):
        at = (i % 10) * each + np.minimum(rnd.geometric(0.08, 25), each) - 1
        x[i, at] = rnd.random(25) + 0.2
    x /= np.linalg.norm(x, axis=1)[:, None]
    place, term = np.nonzero(x)
    order = K.grouped(term, place, x[place, term], n)
    assert sorted(order) == list(range(n))
    rank = np.argsort(order)
    postings = K.Postings(x.shape[1], n, term, rank[place], x[place, term])
    assert 0 < (postings.row >= 0).sum() < x.shape[1]
    queries = x[:100] * (rnd.random((100, x.shape[1])) < 0.6)
    queries[7] = 0
    at, places = np.nonzero(queries)
    w = queries[at, places]
    ends = np.r_[0, np.cumsum(np.bincount(at, minlength=100))]
    but = np.where(np.arange(100) % 2, rank[:100], -1)
    for i, (kept, values) in enumerate(postings.search(ends, places, w, 25, but)):
        cosines = (x @ queries[i])[order]
        if but[i] >= 0:
            cosines[but[i]] = 0
        assert np.allclose(cosines[kept], values, atol=1e-6)
        want = np.sort(cosines[cosines > 1e-9])[-25:]
        assert np.allclose(np.sort(values)[-25:], want, atol=1e-6)
    assert postings.opened < 100 * len(postings.matrix) / 3


def test_an_example_is_not_its_own_neighbour(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(prose(rnd, 30) + ["blorst"] * 3 * (i < 30))) for i in range(200)]
    train = spark.createDataFrame([(i, int(i < 30)) for i in range(200)], "doc_id long, label int")
    df = docs(spark, rows)
    got = K.score_documents(df, K.build(df, train)[0]).collect()
    assert all(r.evidence and r.doc_id not in r.evidence for r in got)


def prose(rnd, n):
    return [f"c{chr(97 + k // 26)}{chr(97 + k % 26)}lm" for k in (rnd.randrange(300) for _ in range(n))]


def test_few_labelled_rows(spark):
    """With fewer rows than the chi-square of a sure term there is still an index."""
    rnd = random.Random(6)
    rows = [(i, " ".join(prose(rnd, 20) + ["blorst"] * 3 * (i < 12))) for i in range(24)]
    rows += [(100, " ".join(prose(rnd, 20) + ["blorst"] * 2)), (101, " ".join(prose(rnd, 20)))]
    train = spark.createDataFrame([(i, int(i < 12)) for i in range(24)], "doc_id long, label int")
    df = docs(spark, rows)
    got = {r.doc_id: r for r in K.score_documents(df, K.build(df, train)[0]).collect()}
    assert got[100].predicted == 1 and got[101].predicted == 0


def test_rare_words_are_indexed(spark):
    """A word of five toxic examples, and of no other, leads to them; all terms count in the norms."""
    rnd = random.Random(7)
    toxic = lambda i: ["raremark"] if i < 5 else ["blorst"] * 3 if i < 60 else []
    rows = [(i, " ".join(prose(rnd, 30) + toxic(i))) for i in range(600)]
    rows += [(1000, " ".join(prose(rnd, 30) + ["raremark"])), (1001, "caalm cablm")]
    train = spark.createDataFrame([(i, int(i < 60)) for i in range(600)], "doc_id long, label int")
    df = docs(spark, rows)
    index, _ = K.build(df, train)
    assert {"raremark", "rare*", "caalm", "caal*"} <= index.terms.keys()
    got = {r.doc_id: r for r in K.score_documents(df, index).collect()}
    assert got[1000].score > 0.5 and set(got[1000].evidence) <= set(range(5))
    assert got[1001].predicted == 0 and got[1001].evidence
