"""SimHash near-duplicates: a Gray-order hierarchical index over 64-bit fingerprints.

Fingerprints at ``distance`` or fewer differing bits are linked, exactly and without a limit on
partners. Two such fingerprints agree in at least one of ``distance + 1`` bit blocks, so every
distinct fingerprint is filed once per block, rotated so that the block leads, and the files are
sorted by Gray rank over the cluster. A run of equal blocks forms one index: consecutive
fingerprints are gathered into nodes that hold the bits all of them share (a masked pattern), nodes
into upper nodes, and so on. The search walks pairs of nodes from the top; a pair of groups whose
shared patterns already differ in more than ``distance`` bits is dropped whole, and a pair that
cannot differ in more is linked whole. A task keeps a spanning forest of the links it finds, never
all pairs of a group. Runs longer than ``chunk`` are cut, and cut parts meet pairwise, after the
same pruning on their shared patterns. Components of the links come from star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.keyed import join_grouped
from marketloom.llm.common import id_and_text, map_texts
from marketloom.session import durable

FANOUT = 8
CHUNK = 1 << 15
# Links of 16 bytes that go through a few tasks; more are dealt to all.
FEW = 1 << 16
TASKS = 6
_PAIRS = 1 << 18
_SIGN = np.uint64(1 << 63)


def fingerprints(
    docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (64 bits as a long).

    A-Z are lower-cased, words are runs without ASCII white space, shingles are ``shingle`` words
    joined by spaces, repeats included (fewer words: all of them; none: zero). A bit is set if it
    is set in over half of the XXH64 values (seed 42). Null texts count as empty, repeated rows
    stay repeated, a null id is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            bits, hashes, counts = [], [], []

            def flush() -> None:
                if counts:
                    bits.append(_majority(np.array(hashes, np.uint64), np.array(counts)))
                    hashes.clear()
                    counts.clear()

            for text in batch.column("text").to_pylist():
                words = text.encode().lower().split()
                if len(words) <= shingle:
                    hashes.append(digest(b" ".join(words), 42) if words else 0)
                    counts.append(1)
                else:
                    joined, at, starts = b" ".join(words), 0, []
                    for w in words:
                        starts.append(at)
                        at += len(w) + 1
                    ends = [*starts[shingle:], at]
                    hashes += [digest(joined[a : b - 1], 42) for a, b in zip(starts, ends)]
                    counts.append(len(ends))
                if len(hashes) > 1 << 17:
                    flush()
            flush()
            fp = np.concatenate(bits) if bits else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"]
            )

    return map_texts(id_and_text(docs, id_col, text_col), run, "doc_id long, fp long")


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per run of ``counts`` hashes the 64 majority bits."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a code word in the reflected Gray order."""
    x = x.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _blocks(n: int) -> list[tuple[int, int]]:
    """(left rotation, width) of ``n`` blocks that cover the 64 bits."""
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


class _Level:
    """Nodes of one level over sorted items: first child, shared ones (``low``), union (``high``)."""

    def __init__(self, low, high, group, first):
        self.low, self.high, self.group, self.first = low, high, group, first

    def above(self) -> _Level:
        begins = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]])
        sizes = np.diff(np.r_[begins, len(self.group)])
        place = np.arange(len(self.group)) - np.repeat(begins, sizes)
        starts = np.flatnonzero(place % FANOUT == 0)
        return _Level(
            np.bitwise_and.reduceat(self.low, starts),
            np.bitwise_or.reduceat(self.high, starts),
            self.group[starts],
            np.r_[starts, len(self.group)],
        )


def _least(a_low, a_high, b_low, b_high):
    """Bits in which all of one node differ from all of the other."""
    return np.bitwise_count((a_low & ~b_high) | (b_low & ~a_high))


def _most(a_low, a_high, b_low, b_high):
    """Bits in which any member of one node may differ from any member of the other."""
    return np.bitwise_count((a_high | b_high) & ~(a_low & b_low))


def _children(first, i, j):
    """All pairs of children of the node pairs ``(i, j)``; within one node each pair once."""
    wide, tall = first[i + 1] - first[i], first[j + 1] - first[j]
    total = wide * tall
    at = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    t = np.repeat(tall, total)
    a = np.repeat(first[i], total) + at // t
    b = np.repeat(first[j], total) + at % t
    keep = a <= b
    return a[keep], b[keep]


def links(fp: np.ndarray, group: np.ndarray, distance: int, cross: np.ndarray | None = None):
    """A spanning forest of all pairs of one group at ``distance`` or fewer differing bits.

    ``fp`` is sorted by group and Gray rank. With ``cross`` (two values) only pairs of members on
    different sides need to be found. Returns two arrays of places.
    """
    n = len(fp)
    root = np.arange(n)
    if n < 2:
        return root[:0], root[:0]
    levels = [_Level(fp, fp, group, np.arange(n + 1))]
    while np.any(levels[-1].group[1:] == levels[-1].group[:-1]):
        levels.append(levels[-1].above())
    tops = np.arange(len(levels[-1].group))
    stack = [(len(levels) - 1, tops, tops)]
    out_a, out_b = [], []
    while stack:
        depth, i, j = stack.pop()
        if len(i) > _PAIRS:
            half = len(i) // 2
            stack += [(depth, i[:half], j[:half]), (depth, i[half:], j[half:])]
            continue
        at = levels[depth]
        near = (i == j) | (_least(at.low[i], at.high[i], at.low[j], at.high[j]) <= distance)
        i, j = i[near], j[near]
        if depth == 0:
            differ = i != j
            if cross is not None:
                differ &= cross[i] != cross[j]
            out_a.append(i[differ])
            out_b.append(j[differ])
        elif len(i):
            whole = _most(at.low[i], at.high[i], at.low[j], at.high[j]) <= distance
            if whole.any():
                a, b = i[whole], j[whole]
                begins, ends = a, b + 1
                nodes = np.unique(np.concatenate([a, b]))
                begins, ends = nodes, nodes + 1
                head = np.arange(len(at.group) + 1)
                for d in range(depth, 0, -1):
                    begins, ends = levels[d].first[begins], levels[d].first[ends]
                    head = levels[d].first[head]
                sizes = ends - begins
                places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                out_a += [np.repeat(begins, sizes), head[a]]
                out_b += [np.repeat(begins, sizes) + places, head[b]]
            rest = ~whole
            if rest.any():
                stack.append((depth - 1, *_children(at.first, i[rest], j[rest])))
        if sum(map(len, out_a)) > 4 * _PAIRS:
            root = _merge(root, np.concatenate(out_a), np.concatenate(out_b))
            out_a, out_b = [], []
    if out_a:
        root = _merge(root, np.concatenate(out_a), np.concatenate(out_b))
    hung = np.flatnonzero(root != np.arange(n))
    return root[hung], hung


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least place per component after adding the links ``a``-``b``."""
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


_FOUND = "a long, b long, block int, lead long, low long, high long, n int, fps binary, ids binary"
_KEY = ("block", "lead")


def _found_batch(a=(), b=(), chunk=None) -> pa.RecordBatch:
    n = len(a) + (chunk is not None)
    cols = {"a": pa.array([*a, *([None] if chunk else [])], pa.int64()), "b": pa.array([*b, *([None] if chunk else [])], pa.int64())}
    kinds = {"block": pa.int32(), "lead": pa.int64(), "low": pa.int64(), "high": pa.int64(), "n": pa.int32(), "fps": pa.binary(), "ids": pa.binary()}
    for c, kind in kinds.items():
        cols[c] = pa.array([None] * (n - (chunk is not None)) + ([chunk[c]] if chunk else []), kind)
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def near_pairs(classes: DataFrame, distance: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Links ``a``, ``b`` (ids) that connect exactly the fingerprints at ``distance`` or fewer bits.

    ``classes`` holds each fingerprint once: ``fp``, ``rep`` (its id). Pairs within a component may
    be left out where others already connect it.
    """
    parts = _blocks(distance + 1)

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for k, (left, _) in enumerate(parts):
                turned = (fp << np.uint64(left)) | (fp >> np.uint64(64 - left)) if left else fp
                rank = (gray_rank(turned) ^ _SIGN).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fp), k, np.int32)), pa.array(rank), batch.column("rep")],
                    ["block", "rank", "rep"],
                )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within the runs of a partition; runs that may go on elsewhere leave their chunk."""
        held: list[tuple] = []  # (block, rank, rep) arrays of the open runs
        started = False

        def runs(block, rank):
            width = np.array([w for _, w in parts], np.uint64)[block]
            lead = rank >> (np.uint64(64) - width)
            return lead, np.cumsum(np.r_[0, (lead[1:] != lead[:-1]) | (block[1:] != block[:-1])])

        def work(block, rank, rep, open_ends):
            lead, group = runs(block, rank)
            fp = rank ^ (rank >> np.uint64(1))  # back from the rank to the turned fingerprint
            a, b = links(fp, group, distance)
            if len(a):
                yield _found_batch(rep[a].tolist(), rep[b].tolist())
            for g in open_ends(group):
                at = np.flatnonzero(group == g)
                f = fp[at]
                yield _found_batch(
                    chunk={
                        "block": int(block[at[0]]),
                        "lead": int(lead[at[0]]),
                        "low": int(np.bitwise_and.reduce(f).view(np.int64)),
                        "high": int(np.bitwise_or.reduce(f).view(np.int64)),
                        "n": len(at),
                        "fps": f.astype("<u8").tobytes(),
                        "ids": rep[at].astype("<i8").tobytes(),
                    }
                )

        for batch in batches:
            held.append(
                (
                    batch.column("block").to_numpy(),
                    batch.column("rank").to_numpy().view(np.uint64) ^ _SIGN,
                    batch.column("rep").to_numpy(),
                )
            )
            while sum(len(h[0]) for h in held) >= 2 * chunk:
                block, rank, rep = (np.concatenate(c) for c in zip(*held))
                cut = chunk
                # The run at the cut goes on, and the first may have begun before: both stay open.
                yield from work(block[:cut], rank[:cut], rep[:cut], lambda g: sorted({0, int(g[-1])}))
                started = True
                held = [(block[cut:], rank[cut:], rep[cut:])]
        if held:
            block, rank, rep = (np.concatenate(c) for c in zip(*held))
            if len(block):
                yield from work(block, rank, rep, lambda g: sorted({0, int(g[-1])}))

    sorted_files = (
        classes.select("fp", "rep")
        .mapInArrow(filed, "block int, rank long, rep long")
        .repartitionByRange("block", "rank")
        .sortWithinPartitions("block", "rank")
    )
    found = durable(sorted_files.mapInArrow(search, _FOUND))
    cut = found.where("fps is not null").drop("a", "b").withColumn("chunk", F.xxhash64("ids"))
    low, high = {}, {}
    for side in ("l", "r"):
        low[side], high[side] = F.col(f"{side}.low"), F.col(f"{side}.high")
    differ = low["l"].bitwiseAND(F.bitwise_not(high["r"])).bitwiseOR(
        low["r"].bitwiseAND(F.bitwise_not(high["l"]))
    )
    slim = cut.select(*_KEY, "chunk", "low", "high")
    pairs = (
        slim.alias("l")
        .join(slim.alias("r"), [F.col(f"l.{k}") == F.col(f"r.{k}") for k in _KEY])
        .where((F.col("l.chunk") < F.col("r.chunk")) & (F.bit_count(differ) <= distance))
        .select(*[F.col(f"l.{k}") for k in _KEY], F.col("l.chunk").alias("left"), F.col("r.chunk").alias("right"))
    )
    full = cut.select(*_KEY, "chunk", "fps", "ids")
    left, right = (full.toDF(*_KEY, side, f"fps_{side}", f"ids_{side}") for side in ("left", "right"))
    both = pairs.join(left, [*_KEY, "left"]).join(right, [*_KEY, "right"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fp = np.concatenate([np.frombuffer(row[f"fps_{s}"], "<u8") for s in ("left", "right")])
                rep = np.concatenate([np.frombuffer(row[f"ids_{s}"], "<i8") for s in ("left", "right")])
                side = np.r_[np.zeros(len(row["fps_left"]) // 8, int), np.ones(len(row["fps_right"]) // 8, int)]
                order = np.argsort(gray_rank(fp), kind="stable")
                fp, rep, side = fp[order], rep[order], side[order]
                a, b = links(fp, np.zeros(len(fp), int), distance, side)
                yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], ["a", "b"])

    within = found.where("fps is null").select("a", "b")
    return within.unionByName(both.mapInArrow(meet, "a long, b long"))


def components(pairs: DataFrame) -> DataFrame:
    """``id``, ``component``: the least id reachable, for every id that has a link.

    Alternates large-star and small-star contraction until nothing changes; every round is a
    written table. Rounds grow with the logarithm of the longest chain. Up to ``FEW`` links go
    through ``TASKS`` tasks a stage and a broadcast instead of all shuffle partitions: the driver
    keeps a record of every task, and the rounds of few links would make most of them.
    """

    def once(edges: DataFrame, few: bool = False) -> DataFrame:
        links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        return durable(links.coalesce(TASKS) if few else links)

    def beside(edges: DataFrame, least: DataFrame, few: bool) -> DataFrame:
        return edges.join(F.broadcast(least.coalesce(TASKS)), "a") if few else join_grouped(edges, least, "a", "inner")

    def state(edges: DataFrame):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = once(pairs)
    seen = state(edges)
    while seen[0]:
        few = seen[0] <= FEW
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = beside(both.where("b > a"), least, few).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = once(large, few)
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = beside(edges, least, few)
        edges = once(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))), few
        )
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))


def near_duplicates(
    docs: DataFrame,
    shingle: int = 4,
    distance: int = 4,
    chunk: int = CHUNK,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id``, ``fp``, ``component`` (least id reachable over links).

    Equal fingerprints are one class from the start, so copies never meet as pairs; a document
    without any words has fingerprint zero and links like others. A row with a null id keeps its
    fingerprint, links nothing and has a null component. Repeated ids and rows are kept. An empty
    table gives an empty result.
    """
    own = durable(fingerprints(docs, shingle, id_col, text_col))
    classes = durable(own.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    comp = components(near_pairs(classes, distance, chunk))
    named = classes.join(comp, classes["rep"] == comp["id"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component")
    )
    joined = join_grouped(own, named, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component"))
