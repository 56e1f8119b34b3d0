"""Removal against a plain search of every string, and the merge against sorting."""

import hashlib
import random

import numpy as np
import pytest

from marketloom.llm import suffix_dedup as S
from llm_rows import clashing, docs


def plain(rows, length=100):
    """rows: (order, text) sorted by order. Removed bytes by looking up every string."""
    seen, out = set(), []
    for text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = raw if not gone.any() else np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rnd):
    words = [f"w{rnd.randrange(9999)}" for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    hot = prose(60)
    edge = "q" * 40 + prose(12)[:60]
    texts = []
    for i in range(90):
        kind = i % 9
        t = prose(rnd.randrange(5, 120))
        if kind == 0 and i:
            t = texts[rnd.randrange(i)]
        elif kind == 1 and i:
            base = texts[rnd.randrange(i)].split(" ")
            base[rnd.randrange(len(base))] = "edited"
            t = " ".join(base)
        elif kind in (2, 3):
            t = t[: rnd.randrange(50)] + hot + t
        elif kind == 4:
            t += edge[: rnd.choice([99, 100, 101])] + str(i)
        elif kind == 5:
            t = hot[: rnd.randrange(95, 130)] + t + hot[rnd.randrange(50) :]
        texts.append(t)
    return texts + ["a" * 450, "a" * 130, "ab" * 150, "\0" * 205, "é" * 120, "x" * 99, "x" * 100, "", None, " " * 300, hot * 40]


def test_bytes_equal_a_plain_search(spark, tmp_path):
    texts = corpus(random.Random(7))
    rows = [(3 * i - 20, t) for i, t in enumerate(texts)]
    shuffled = random.Random(1).sample(rows, len(rows))
    path = f"{tmp_path}/d"
    clashing(docs(spark, shuffled), ["row", "lo", "hi", "bucket", "spans", "kept", "open"]).repartition(4).write.parquet(path)
    want = dict(zip([i for i, _ in rows], plain([t for _, t in rows])))
    for buckets in (1, 13):
        got = S.digest(S.remove_repeats(spark.read.parquet(path), buckets=buckets)).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == want
        assert len(got) == len(rows)


def test_null_ids_repeated_ids_and_no_rows(spark, tmp_path):
    t = " ".join(f"word{k}" for k in range(60))
    docs(spark, [(None, t), (4, t), (4, t), (9, None)]).coalesce(1).write.parquet(f"{tmp_path}/d")
    stored = spark.read.parquet(f"{tmp_path}/d")
    got = sorted((str(r.doc_id), r.n_removed) for r in S.remove_repeats(stored).collect())
    assert got == sorted([("None", 0), ("4", len(t)), ("4", len(t)), ("9", 0)])
    assert S.remove_repeats(stored.where("doc_id > 99")).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_merge_equals_sorting(seed):
    rnd = random.Random(seed)
    width = rnd.choice([1, 4, 8])
    runs, every = [], []
    for _ in range(rnd.randrange(1, 9)):
        rows = sorted(bytes(rnd.choice(b"ab") for _ in range(width)) for _ in range(rnd.randrange(0, 30)))
        every += rows
        if rows:
            shared, rest = S.front_code(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, width))
            decoded = S.front_decode(shared.tobytes(), rest, width)
            assert decoded[0] == rows
            runs.append(decoded)
    if not runs:
        return
    order, common = S.merge_runs(runs, width)
    at = [0] * len(runs)
    merged = []
    for r in order:
        merged.append(runs[r][0][at[r]])
        at[r] += 1
    assert merged == sorted(every)
    for x, y, k in zip(merged, merged[1:], common[1:]):
        assert k == next((i for i in range(width) if x[i] != y[i]), width)
