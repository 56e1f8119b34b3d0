"""The stages on a small corpus with known cases, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from marketloom.llm import latent_decontam, pfair
from marketloom.session import durable
from llm_rows import docs, vocabulary  # noqa: F401
from test_bitpack import whole
from test_pfair import plain_order
from test_simhash_gray import plain_components, plain_fp

ITEM = "Every seventh lantern in Marrow Street burns blue until the harbour bell rings twice. The keeper is Odo Finch."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(12)
    vocab = [f"word{k}" for k in range(900)] + ["the", "of", "and"] * 60
    prose = lambda n: "\n".join(" ".join(rnd.choice(vocab) for _ in range(12)) + "." for _ in range(n))
    rows = []
    for i in range(120):
        text = prose(rnd.randrange(6, 30))
        if i % 10 == 3:
            text = "\n".join(" ".join(f"{rnd.choice(vocab)}***" for _ in range(9)) for _ in range(12))
        if i % 10 == 5:
            text += "\n" + ITEM
        rows.append((i, text))
    rows += [(200 + i, rows[i][1]) for i in (0, 1, 11)] + [(300, None), (301, "short")]
    rows += [(400, rows[2][1].replace("word1 ", "word2 ")), (401, prose(3000))]
    d = str(tmp_path_factory.mktemp("sf"))
    docs(spark, rows).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 3), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "tiny")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, dict(rows)


def test_each_stage_and_the_whole(spark, folder, vocabulary):
    d, texts = folder
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    start = spark.read.parquet(f"{d}/documents.parquet")
    kept = durable(P.STAGES[0][1](spark, start, d))
    want = {i for i, t in texts.items() if i < 300 and i % 10 != 3} | {400, 401}
    assert ids(kept) == want and kept.columns == start.columns
    unique = durable(P.STAGES[1][1](spark, kept, d))
    comp = plain_components({i: plain_fp(texts[i]) for i in want})
    want = {i for i in want if comp[i] == i}
    assert ids(unique) == want and unique.columns == start.columns
    clean = durable(P.STAGES[2][1](spark, unique, d))
    want = {i for i in want if ITEM not in texts[i]}
    assert ids(clean) == want and clean.columns == start.columns
    mixed = durable(P.STAGES[3][1](spark, clean, d))
    assert ids(mixed) == want and mixed.columns == start.columns
    source = {i: f"=src{i % 3}" for i in want}
    before, blocks, places = {}, {}, {}
    for i in sorted(want):
        s, n = source[i], len(texts[i].encode()) + 1
        places[i] = before.get(s, 0)
        before[s] = places[i] + n
    blocks = {s: (n - 1) // pfair.BLOCK_BYTES + 1 for s, n in before.items()}
    shares = pfair.whole_shares({s: n**pfair.SMOOTHING for s, n in before.items()})
    slot = {x: t for t, x in enumerate(plain_order(shares, blocks))}
    order = sorted(want, key=lambda i: (slot[source[i], places[i] // pfair.BLOCK_BYTES], places[i]))
    got = P.STAGES[4][1](spark, mixed, d).orderBy("start").collect()
    assert [r.doc_id for r in got] == order
    name, at = vocabulary("byte_bpe_50k.json"), 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(whole(name, texts[r.doc_id])) + 1)
        at += r.n_tokens
    full = P.run(spark, d)
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, got))


def test_cosine_candidates_hold_every_close_window():
    """The latent search against plain TF-IDF cosines of all windows and passages."""
    import numpy as np

    rnd = random.Random(2)
    vocab = [f"w{k}" for k in range(300)]
    passages = [(k, [rnd.choice(vocab) for _ in range(rnd.randrange(10, 60))], []) for k in range(20)]
    index = {w: i for i, w in enumerate(sorted({w for _, p, _ in passages for w in p}))}
    idf = np.array([1.0 + (i % 5) for i in range(len(index))])
    basis = np.eye(len(index))
    s = latent_decontam.Searcher(passages, index, idf, 6.0, basis)
    texts = []
    for k in range(30):
        noise = [rnd.choice([*vocab, "out1", "out2"]) for _ in range(rnd.randrange(0, 120))]
        at = rnd.randrange(len(noise) + 1)
        texts.append(noise[:at] + passages[k % 20][1] + noise[at:])
    found = {(d, a, p) for d, a, _, p, _ in s.candidates(texts, 0.4)}
    step, span = latent_decontam.STRIDE, latent_decontam.SPAN
    n = 0
    for d, words in enumerate(texts):
        last = max(1, -(-len(words) // step) - span + 1)
        for a in range(0, last * step, step):
            window = words[a : a + step * span]
            for p, (_, passage, _) in enumerate(passages):
                def vec(ws):
                    v = np.zeros(len(index) + 1)
                    for w in ws:
                        v[index.get(w, len(index))] += idf[index[w]] if w in index else 6.0
                    return v
                x, y = vec(window), vec(passage)
                if x @ y >= 0.4 * np.linalg.norm(x) * np.linalg.norm(y) + 1e-6:
                    n += 1
                    assert (d, a, p) in found
    assert n > 30


def test_common_subsequence_and_answers():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rnd = random.Random(0)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(1, 70))] for _ in range(2))
        assert latent_decontam.common_subsequence(a, b) == plain(a, b)
    (item,) = latent_decontam.passages_of(4, ITEM)
    assert item[2] == ["the", "keeper", "is", "odo", "finch"]
    assert latent_decontam.passages_of(4, "too few words") == []


def test_leaks_copies_paraphrases_and_clean_rows(spark):
    rnd = random.Random(6)
    noise = lambda n: " ".join(f"n{rnd.randrange(5000)}" for _ in range(n))
    words = ITEM.split()
    para = " ".join(w if i % 4 or i > 12 else "other" for i, w in enumerate(words))
    far = " ".join(w if i % 2 else "other" for i, w in enumerate(words))
    rows = [(1, noise(90) + " " + ITEM.upper() + " " + noise(50)), (2, noise(50) + para + " " + noise(9)), (3, noise(300)),
            (4, far + noise(30)), (5, None), (6, ""), (None, ITEM), (7, noise(20_000) + " " + ITEM), (7, ITEM), (8, "the of and in the")]
    df = docs(spark, rows)
    bench = spark.createDataFrame([(9, ITEM, "x"), (9, ITEM, "y"), (None, ITEM, "z"), (10, None, ""), (11, "a b", "")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in latent_decontam.find_leaks(df, bench).collect()}
    assert got == {(1, 9), (2, 9), (None, 9), (7, 9)}
    small = {(r.doc_id, r.item_id) for r in latent_decontam.find_leaks(df, bench.union(spark.createDataFrame([(20 + k, noise(30), "") for k in range(5)], bench.schema)), block=2).collect()}
    assert small == got
    left = latent_decontam.without_leaks(df, bench)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 8] and left.columns == df.columns
    none = df.where("doc_id > 99")
    assert latent_decontam.find_leaks(none, bench).count() == 0
    assert latent_decontam.find_leaks(df, bench.where("item_id > 99")).count() == 0


def test_svd_spans_the_leading_directions(spark):
    import numpy as np

    rnd = np.random.default_rng(0)
    a = rnd.normal(size=(60, 8)) @ rnd.normal(size=(8, 40))
    rows = spark.createDataFrame([(list(range(40)), r.tolist()) for r in a], "terms array<int>, weights array<double>").repartition(4)
    v = latent_decontam.randomised_svd(rows, 40, 8)
    assert v.shape == (40, 8) and np.allclose(a @ v @ v.T, a, atol=1e-6)
    assert np.allclose(v.T @ v, np.eye(8), atol=1e-8)



def test_dedup_goes_by_row_and_keeps_columns(spark):
    a, b, c = "one two three four five six", "quite another text with other words", "seven eight nine ten eleven"
    frame = docs(spark, [(1, a), (5, a), (5, b), (7, c), (7, c), (None, a)]).withColumn("_row", F.lit("x"))
    kept = P.near_duplicates(spark, frame, "")
    assert sorted((r.doc_id or 0, r.text, r._row) for r in kept.collect()) == [
        (0, a, "x"), (1, a, "x"), (5, b, "x"), (7, c, "x"),
    ]


def test_mixing_leaves_a_column_of_the_same_name(spark):
    frame = docs(spark, [(i, f"text {i}") for i in range(6)]).withColumn("_bytes", F.lit(77))
    assert {r._bytes for r in P.mix_sources(spark, frame, "").collect()} == {77}
