"""Scores against plain counting, document by document."""

import math
import random
from collections import Counter

import pytest

from marketloom.llm import backoff_lm as B
from llm_rows import clashing, docs


def plain(texts, order, backoff):
    words = [(t or "").encode().lower().split() for t in texts]
    grams = lambda w: Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    every = sum(map(grams, words), Counter())
    total = sum(map(len, words))
    out = []
    for w in words:
        c = every - grams(w)
        score = top = 0
        for i in range(len(w)):
            value = math.log(backoff**order / (total - len(w) + 1))
            for k in range(min(order, i + 1), 0, -1):
                n = c[tuple(w[i - k + 1 : i + 1])]
                if n:
                    context = c[tuple(w[i - k + 1 : i])] if k > 1 else total - len(w)
                    value = math.log(backoff ** (order - k) * n / context)
                    top += k == order
                    break
            score += value
        out.append((len(w), score, top))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_plain_counts(spark, order, tmp_path):
    rnd = random.Random(order)
    vocab = ["the"] * 20 + [f"w{k}" for k in range(60)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 2, 30]))) for _ in range(150)]
    texts += [None, "", " \n ", "THE the", "only here", "é é", texts[3], "the " * 20_000]
    rows = list(enumerate(texts)) + [(None, "the w1"), (3, texts[3])]
    clashing(docs(spark, rows), ["batch", "n_words", "bucket"]).repartition(5).write.parquet(f"{tmp_path}/d")
    stored = spark.read.parquet(f"{tmp_path}/d")
    got = B.score_documents(stored, order=order, buckets=7).collect()
    want = {}
    for (i, _), x in zip(rows, plain([t for _, t in rows], order, B.BACKOFF)):
        want.setdefault(i, []).append(x)
    assert len(got) == len(rows)
    for r in got:
        n, score, top = want[r.doc_id].pop()
        assert (r.n_words, r.n_top) == (n, top)
        assert r.log_score == pytest.approx(score, abs=1e-6)
        assert (r.mean_log_score is None) == (n == 0)
    assert B.score_documents(stored.where("doc_id < 0")).count() == 0
