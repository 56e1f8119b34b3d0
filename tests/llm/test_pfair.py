"""Mixed orders against a slot-by-slot schedule."""

import random
from fractions import Fraction

import pytest

from marketloom.llm import pfair as P
from llm_rows import clashing, docs


@pytest.mark.parametrize("seed", range(12))
def test_a_period_deviates_by_less_than_a_block(seed):
    rnd = random.Random(seed)
    shares = {f"s{k}": rnd.choice([1, 2, 7, 100]) for k in range(rnd.randrange(1, 9))}
    slots = P.period_slots(shares)
    total = sum(shares.values())
    assert sorted(t for x in slots.values() for t in x) == list(range(total))
    for s, n in shares.items():
        taken = 0
        for t in range(total + 1):
            assert abs(taken - Fraction(t * n, total)) < 1
            taken += t in slots[s]


def plain_order(shares, blocks):
    """Slot by slot: earliest deadline among released blocks, restarted when a source runs out."""
    left, order = {s: n for s, n in blocks.items() if n}, []
    while left:
        active = {s: shares[s] for s in left if shares.get(s)} or dict.fromkeys(left, 1)
        total, done, t = sum(active.values()), dict.fromkeys(active, 0), 0
        while all(left[s] for s in active):
            ready = [(-(-(done[s] + 1) * total // n), s) for s, n in active.items() if done[s] * total // n <= t]
            _, s = min(ready)
            order.append((s, blocks[s] - left[s]))
            done[s] += 1
            left[s] -= 1
            t += 1
        left = {s: n for s, n in left.items() if n}
    return order


@pytest.mark.parametrize("seed", range(12))
def test_phases_give_the_slots_of_the_plain_schedule(seed):
    rnd = random.Random(seed)
    shares = {f"s{k}": rnd.choice([1, 3, 5, 40]) for k in range(rnd.randrange(1, 7))}
    blocks = {s: rnd.choice([0, 1, 9, 200]) for s in [*shares, "unweighted", "other"]}
    slots = {}
    for s, start, end, base, period, n, places in P.phases(shares, blocks):
        for b in range(start, end):
            k = b - start
            slots[base + k // n * period + places[k % n]] = (s, b)
    assert [slots[t] for t in sorted(slots)] == plain_order(shares, blocks)
    assert sorted(slots) == list(range(sum(blocks.values())))


def test_documents_are_placed_by_running_size(spark):
    rnd = random.Random(3)
    rows = [(i, None if i % 50 == 0 else "x" * rnd.choice([0, 5, 80, 700])) for i in range(600)]
    rows += [(None, "none"), (5, "twice"), (9999, "y" * 3000)]
    df = clashing(docs(spark, rows).drop("source"), ["mix_slot", "_part", "_source", "_size", "extra"])
    from pyspark.sql import functions as F

    df = df.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 4)))
    got = P.mix(df.repartition(4), "n_chars", {"hot": 0.5, "s0": 0.2, "s1": 0.2, None: 0.1}, block_bytes=512).collect()
    assert len(got) == len(rows)
    key = lambda r: "" if r.source is None else "=" + r.source
    before, blocks = {}, {}
    for r in sorted(got, key=lambda r: (key(r), r.mix_before)):
        s = key(r)
        assert r.mix_before == before.get(s, 0)
        assert r.mix_block == r.mix_before // 512
        before[s] = r.mix_before + r.n_chars + 1
        blocks[s] = (before[s] - 1) // 512 + 1
    ids = {}
    for r in sorted(got, key=lambda r: r.mix_before):
        ids.setdefault(key(r), []).append(-1 if r.doc_id is None else r.doc_id)
    assert all(x == sorted(x) for x in ids.values())
    shares = P.whole_shares({"=hot": 0.5, "=s0": 0.2, "=s1": 0.2, "": 0.1})
    places = {x: t for t, x in enumerate(plain_order(shares, blocks))}
    assert all(r.mix_slot == places[key(r), r.mix_block] for r in got)
    assert P.mix(df.where("doc_id > 99999"), "n_chars").count() == 0


def test_rows_of_one_id_have_an_order_and_are_divided(spark, monkeypatch):
    """Half the rows have no id: however they arrive they are placed alike, over several tasks."""
    rows = [(None if i % 2 else i, f"text {i} " + "x" * (i % 17)) for i in range(4000)]
    df, stored = docs(spark, rows), []
    monkeypatch.setattr(P, "durable", lambda d, keep=P.durable: stored.append(keep(d)) or stored[-1])
    placed = []
    for given in (df.repartition(3), df.orderBy("text")):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = P.mix(given, "n_chars", block_bytes=512).collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        placed.append(sorted((r.text, r.mix_before, r.mix_slot) for r in got))
    assert placed[0] == placed[1]
    counts = [r["count"] for r in stored[0].where("_id is null").groupBy("_part").count().collect()]
    assert len(counts) > 2 and max(counts) < 1500
