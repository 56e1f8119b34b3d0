"""Prefix trie of conversations; subtree totals by parallel tree contraction.

A node is a distinct beginning of turns (role and text). It is named by 128 bits, the exclusive or of
one hash per turn and depth, so the names of all beginnings of a conversation are running values over
its sorted turns, and a conversation of any length is cut between tasks. Totals over subtrees come
from contraction: compress splices every chain of nodes with one child by pointer doubling, rake
hands the leaves' values to their parents, and the two alternate until the root is left; after both,
at most half of the nodes remain. Then the chains are expanded in reverse, from the totals of the
nodes they lead to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.keyed import join_grouped
from marketloom.functions.scan import PART, PLACE, cut_sorted, earlier_parts, numbered, on_part
from marketloom.session import durable

_WORD = r"[^\x20\x09-\x0D]+"
NAME = ["a", "b"]
_VALUES = ["leaf", "saved"]
# Bytes of joined ids in one row on their way to the hash.
_CHUNK = 1 << 16


def _xor(*names: str) -> Column:
    return reduce(lambda x, y: x.bitwiseXOR(y), [F.coalesce(F.col(n), F.lit(0).cast("long")) for n in names])


def _named(df: DataFrame) -> DataFrame:
    """Hashes ``w1, w2`` of the turn at its depth."""
    return df.withColumns({"w1": F.xxhash64("depth", "e1"), "w2": F.xxhash64("e2", "depth")})


def beginnings(turns: DataFrame, block: int | None = None, spread: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations (``conv_id, turns, a, b``: their last node) and stored rows of nodes passed.

    A row holds ``conv_id, depth``, the node's name ``a, b``, its parent's ``pa, pb`` and the words of
    the turn. With ``block``, conversation c begins with the first h turns of conversation
    ``c - c % block`` in place of its own first h, where ``h = crc32(c) % spread``.
    """
    slim = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    )
    slim = slim.withColumns(
        {
            "e1": F.xxhash64(F.lit(1), "role", "text"),
            "e2": F.xxhash64("text", F.lit(2), "role"),
            "words": F.regexp_count("text", F.lit(_WORD)).cast("long"),
        }
    )
    kept = ["conv_id", "e1", "e2", "words"]
    placed = durable(numbered(cut_sorted(slim, ["conv_id"], ["turn", "role", "text"], kept), ["conv_id"]))
    own = placed.groupBy("conv_id").agg(F.max("pos").alias("n_own"))
    if block:
        shape = own.withColumns(
            {
                "h": F.crc32(F.col("conv_id").cast("string")) % spread,
                "base": F.col("conv_id") - F.pmod("conv_id", F.lit(block)),
            }
        )
        source = own.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
        shape = shape.join(source, "base", "left")
        shared = F.least("h", F.coalesce("n_base", F.lit(0))).cast("long")
    else:
        shape = own.withColumns({"h": F.lit(0).cast("long"), "base": F.lit(None).cast("long")})
        shared = F.lit(0).cast("long")
    shape = durable(
        shape.select("conv_id", "base", "h", shared.alias("shared"), "n_own").withColumn(
            "turns", F.col("shared") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))
        )
    )
    first = placed.where(F.col("pos") < spread).select(
        F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "e1", "e2", "words"
    )
    # At most spread - 1 rows per conversation.
    head = _named(shape.join(first, "base").where("depth <= shared"))
    upto = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    heads = head.select(
        "conv_id", "depth", "turns", "w1", "w2", "words",
        F.bit_xor("w1").over(upto).alias("a"), F.bit_xor("w2").over(upto).alias("b"),
    )
    begun = head.groupBy("conv_id").agg(F.bit_xor("w1").alias("ha"), F.bit_xor("w2").alias("hb"))
    shape = shape.join(begun, "conv_id", "left")
    rest = _named(
        join_grouped(placed, shape, "conv_id", "inner")
        .where("pos > h")
        .withColumn("depth", F.col("shared") + F.col("pos") - F.col("h"))
    )
    by_part = rest.groupBy("conv_id", PART).agg(F.bit_xor("w1").alias("t1"), F.bit_xor("w2").alias("t2"))
    before = earlier_parts(["conv_id"])
    carried = by_part.select(
        "conv_id", PART, F.bit_xor("t1").over(before).alias("c1"), F.bit_xor("t2").over(before).alias("c2")
    )
    here = Window.partitionBy("conv_id", PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    rests = (
        on_part(rest, carried, ["conv_id"])
        .withColumns({"r1": F.bit_xor("w1").over(here), "r2": F.bit_xor("w2").over(here)})
        .select(
            "conv_id", "depth", "turns", "w1", "w2", "words",
            _xor("ha", "c1", "r1").alias("a"), _xor("hb", "c2", "r2").alias("b"),
        )
    )
    passed = durable(
        heads.unionByName(rests).select(
            "conv_id", "depth", "words", *NAME, _xor("a", "w1").alias("pa"), _xor("b", "w2").alias("pb"),
            (F.col("depth") == F.col("turns")).alias("last"),
        )
    )
    zero = [F.lit(0).cast("long").alias(c) for c in NAME]
    ends = passed.where("last").select("conv_id", *NAME).unionByName(
        shape.where("turns = 0").select("conv_id", *zero)
    )
    return ends, passed.drop("last")


def nodes(ends: DataFrame, passed: DataFrame) -> DataFrame:
    """Stored nodes: ``num, parent`` (numbers), name, ``conv_id, depth, parent_conv_id, n_convs,
    n_children, words``."""
    null = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    root = ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    each = passed.groupBy(*NAME).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        *[F.min(c).alias(c) for c in ("depth", "pa", "pb", "words")],
    )
    every = each.unionByName(
        root.select(
            "conv_id", "n_convs", zero.alias("a"), zero.alias("b"), zero.alias("depth"), zero.alias("words"),
            null.alias("pa"), null.alias("pb"),
        )
    )
    listed = durable(every.withColumn("num", F.monotonically_increasing_id()))
    above = listed.select(
        F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("num").alias("parent"), F.col("conv_id").alias("parent_conv_id")
    )
    linked = durable(join_grouped(listed, above, ["pa", "pb"], "left"))
    below = linked.where("parent is not null").groupBy(F.col("parent").alias("num")).agg(F.count("*").alias("n_children"))
    return durable(linked.join(below, "num", "left").withColumn("n_children", F.coalesce("n_children", zero)))


def subtree_totals(tree: DataFrame) -> DataFrame:
    """``num, leaf, saved`` summed over the subtree of every node of ``num, parent, leaf, saved``.

    Numbers are unique; a root's parent is null. Every round halves the nodes at least; a round with
    chains of length k takes log k joins to splice them.
    """
    zero = F.lit(0).cast("long")
    kids = tree.where("parent is not null").groupBy(F.col("parent").alias("num")).agg(F.count("*").alias("kids"))
    # ``up_*`` is what the spliced nodes between a node and its parent add to the parent only.
    active = durable(
        tree.select("num", "parent", *_VALUES)
        .join(kids, "num", "left")
        .withColumns({"kids": F.coalesce("kids", zero), **{f"up_{c}": zero for c in _VALUES}})
    )
    spliced, known = [], []
    while not active.where("parent is not null").isEmpty():
        rest, jumps = _compress(active)
        if jumps is not None:
            spliced.append(jumps)
        active, raked = _rake(rest)
        known.append(raked)
    known.append(active.select("num", *_VALUES))
    for jumps in reversed(spliced):
        total = reduce(DataFrame.unionByName, known).select(
            F.col("num").alias("next"), *[F.col(c).alias(f"t_{c}") for c in _VALUES]
        )
        known.append(
            durable(
                join_grouped(jumps, total, "next", "inner").select(
                    "num", *[(F.col(c) + F.col(f"t_{c}")).alias(c) for c in _VALUES]
                )
            )
        )
    return reduce(DataFrame.unionByName, known)


def _compress(active: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The tree without its unary nodes, and for each of them the first node below its chain
    (``next``) with the sums from the one to the other."""
    unary = active.where("parent is not null and kids = 1")
    if unary.isEmpty():
        return active, None
    below = active.where("parent is not null").select(
        F.col("num").alias("next"), F.col("parent").alias("num"), *[F.col(f"up_{c}") for c in _VALUES]
    )
    jumps = durable(
        join_grouped(below, unary.select("num", *_VALUES), "num", "inner").select(
            "num", "next", *[(F.col(c) + F.col(f"up_{c}")).alias(c) for c in _VALUES], F.lit(True).alias("more")
        )
    )
    while not jumps.where("more").isEmpty():
        onward = jumps.select(
            F.col("num").alias("next"), F.col("next").alias("far"), *[F.col(c).alias(f"t_{c}") for c in _VALUES]
        )
        hit = F.col("far").isNotNull()
        doubled = join_grouped(jumps, onward, "next", "left").select(
            "num",
            F.coalesce("far", "next").alias("next"),
            *[(F.col(c) + F.coalesce(f"t_{c}", F.lit(0))).alias(c) for c in _VALUES],
            hit.alias("more"),
        )
        jumps = durable(doubled)
    tops = join_grouped(
        unary.select("num", "parent", *[f"up_{c}" for c in _VALUES]),
        unary.select(F.col("num").alias("parent")),
        "parent",
        "left_anti",
    )
    relinked = tops.join(jumps, "num").select(
        F.col("next").alias("num"),
        F.col("parent").alias("_parent"),
        *[(F.col(c) + F.col(f"up_{c}")).alias(f"_up_{c}") for c in _VALUES],
    )
    rest = active.where("parent is null or kids <> 1").join(relinked, "num", "left")
    return durable(
        rest.select(
            "num",
            F.coalesce("_parent", "parent").alias("parent"),
            "kids",
            *_VALUES,
            *[F.coalesce(f"_up_{c}", f"up_{c}").alias(f"up_{c}") for c in _VALUES],
        )
    ), jumps.drop("more")


def _rake(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree without its leaves, whose values went to their parents, and the leaves."""
    leaves = tree.where("kids = 0 and parent is not null")
    gain = leaves.groupBy(F.col("parent").alias("num")).agg(
        F.count("*").alias("gone"), *[F.sum(F.col(c) + F.col(f"up_{c}")).alias(f"_{c}") for c in _VALUES]
    )
    inner = tree.where("kids > 0 or parent is null").join(gain, "num", "left")
    zero = F.lit(0).cast("long")
    return durable(
        inner.select(
            "num",
            "parent",
            (F.col("kids") - F.coalesce("gone", zero)).alias("kids"),
            *[(F.col(c) + F.coalesce(f"_{c}", zero)).alias(c) for c in _VALUES],
            *[f"up_{c}" for c in _VALUES],
        )
    ), leaves.select("num", *_VALUES)


def prefix_trie(turns: DataFrame, block: int | None = None, spread: int = 4) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie, and the conversations that end at each (``conv_id`` and the node's ``a, b``).

    ``turns``: ``conv_id, turn, role, text``; turns are ordered by ``turn``, null first, then role and
    text. Columns of the nodes: those of ``nodes`` and, over the subtree, ``n_leaves`` and
    ``saved_tokens``: words of a node's turn times the conversations beyond the first that share it.
    A null role or text is an empty one, rows without a conversation belong to none, repeated rows
    are turns of their own, other columns are left out, and an empty table has no nodes.
    """
    ends, passed = beginnings(turns, block, spread)
    listed = nodes(ends, passed)
    own = listed.select(
        "num",
        "parent",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    totals = subtree_totals(own).select(
        "num", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens")
    )
    return listed.join(totals, "num"), ends


def ends_digest(ends: DataFrame) -> DataFrame:
    """``a, b, ends_sha256``: hash of the ids that end at a node, ascending and joined by commas.

    Ids are sorted and joined over the cluster; only the joined stretches of a node meet, as a
    stream, where the hash is taken, so that a node's task holds one stretch at a time.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, node, size = [], None, 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [*[pa.array([x], pa.int64()) for x in (*node, held[0])], pa.array([",".join(map(str, held))])],
                ["a", "b", "first", "ids"],
            )

        for batch in batches:
            for a, b, c in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "conv_id"))):
                if held and ((a, b) != node or size >= _CHUNK):
                    yield flush()
                    held, size = [], 0
                node = (a, b)
                held.append(c)
                size += len(str(c)) + 1
        if held:
            yield flush()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def rows(found):
            a, b, digest = zip(*found)
            return pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(digest)], ["a", "b", "ends_sha256"]
            )

        for batch in batches:
            found = []
            for a, b, ids in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "ids"))):
                if (a, b) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node:
                    found.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256(ids.encode())
            if found:
                yield rows(found)
        if node:
            yield rows([(*node, state.hexdigest())])

    order = [*NAME, "conv_id"]
    joined = (
        ends.select(*order)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(join, "a long, b long, first long, ids string")
    )
    whole = joined.repartition(*NAME).sortWithinPartitions(*NAME, "first")
    return whole.mapInArrow(take, "a long, b long, ends_sha256 string")
