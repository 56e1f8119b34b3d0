"""The trie against one that is walked in memory."""

import hashlib
import random
import zlib

import pytest

from llm_rows import clashing
from marketloom.llm import prefix_trie as pt
from marketloom.llm import queries
from marketloom.llm.common import table

COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, block=20):
    """rows: (conv_id, turn, role, text)."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if block else 0
        built[c] = own.get(c - c % block, [])[:h] + turns[h:] if block else turns
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        kids = [k for k in nodes if len(k) == len(key) + 1 and k[:-1] == key]
        under = [k for k in nodes if k[: len(key)] == key]
        inner = {k[:-1] for k in under if k}
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(key))))
        out.append(
            (
                min(members),
                len(key),
                min(nodes[key[:-1]]) if key else None,
                len(members),
                len(kids),
                sum(k not in inner for k in under),
                sum((len(nodes[k]) - 1) * (len(k[-1][1].encode().split()) if k else 0) for k in under),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def answer(turns, block=20):
    return sorted(map(tuple, queries.trie_rows(turns, block).select(*COLS).collect()), key=str)


def conversations(seed, count):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(count * 2), count):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "bot"]), rng.choice(["a b", "a", "", "c d e", None])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [20, None])
def test_nodes_equal_brute_force(spark, block):
    rows = conversations(3, 150)
    assert answer(frame(spark, rows), block) == brute(rows, block)


def test_long_chain_and_star(spark):
    chain = [(40, i, "u", f"t{i}") for i in range(300)]
    star = [(1000 + 20 * i, 0, "u", f"s{i}") for i in range(300)] + [(9, 0, "u", "s1")] + [(8, 0, "u", "s1")] * 2
    rows = chain + star + [(41, 0, "u", "t0"), (41, 1, "u", "t1"), (41, 2, None, None), (41, 2, "", "")]
    assert answer(frame(spark, rows)) == brute(rows)


def test_totals_of_a_random_tree(spark):
    rng = random.Random(8)
    n = 400
    parent = [None] + [max(0, i - rng.choice([1, 1, 1, 2, 5, i])) for i in range(1, n)]
    leaf = [rng.randint(0, 3) for _ in range(n)]
    tree = spark.createDataFrame([(i, p, leaf[i], i) for i, p in enumerate(parent)], "num long, parent long, leaf long, saved long")
    want = [[leaf[i], i] for i in range(n)]
    for i in range(n - 1, 0, -1):
        want[parent[i]][0] += want[i][0]
        want[parent[i]][1] += want[i][1]
    got = {r["num"]: [r["leaf"], r["saved"]] for r in pt.subtree_totals(tree).collect()}
    assert got == dict(enumerate(want))


def test_odd_rows(spark):
    rows = [(None, 1, "u", "lost"), (3, None, None, None), (3, None, None, None), (-7, 2, "u", "x"), (5, 0, "u", "w " * 50_000)]
    turns = clashing(frame(spark, rows), ["num", "a", "depth", "pos", "_part", "parent"])
    assert answer(turns, None) == brute(rows, None)


def test_empty_table(spark):
    assert answer(frame(spark, [])) == []


def test_whole_table(spark):
    got = queries.queries()["op12_prefix_trie"](spark, "/root/testdata/sf0.001").select(*COLS).collect()
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, got), key=str) == brute(rows)
