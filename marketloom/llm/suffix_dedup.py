"""Removal of repeated byte strings by a sparse suffix array, sorted by distributed merging.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (smaller id, or the
same document and an earlier place). Sorting the suffixes of all places would move many times the
text, so only anchors are sorted: in every window of ``LENGTH`` bytes the place whose next
``PREFIX`` bytes hash lowest. Equal windows have equal anchors, so no repeat is lost.

1. A task finds the anchors of its texts, sorts their suffixes (``PREFIX`` bytes) and sends them out
   front-coded: each as the length shared with the one before and the rest.
2. A receiver merges the sorted runs with a loser tree that carries common-prefix lengths and never
   compares bytes known to be equal. Neighbours that share the whole prefix are one group. All
   windows of an anchor form its stretch of text; anchors with equal stretches, but the first, are
   repeats as a whole. Anchors without a partner are done.
3. Where a group holds different stretches, the windows of the first anchor of each are compared one
   by one, by 128-bit digest, and all but the first of equal ones are repeats.
4. The repeats of a document, joined to its text, give what is left of it.

Equal stretches and windows are reduced to the first within a task before anything is sent, so a
passage that stands in every document is sent once per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import slices
from marketloom.session import durable

LENGTH = 100
PREFIX = 32
_SLICE = 3 << 19
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts of a batch, and where each begins (one more entry at the end)."""
    raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
    bounds = np.cumsum([0, *map(len, raw)])
    return np.frombuffer(b"".join(raw), np.uint8), bounds


def anchors(raw: np.ndarray, bounds: np.ndarray, length: int = LENGTH, prefix: int = PREFIX):
    """(text, anchor, first window, last window) of every anchor; places within the bytes."""
    n, w = len(raw), length - prefix + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none
    wide = np.concatenate([raw, np.zeros(prefix + 8, np.uint8)])
    eight = np.zeros(n + prefix, np.uint64)
    for k in range(8):
        eight |= wide[k : k + n + prefix].astype(np.uint64) << np.uint64(8 * k)
    h = np.zeros(n, np.uint64)
    for k in range(0, prefix, 8):
        h = (h ^ eight[k : k + n]) * _MULT
        h ^= h >> np.uint64(29)
    del eight
    # The place in the low bits (16 GB) settles ties to the left.
    place = np.arange(n, dtype=np.uint64)
    h = (h * _MULT) & ~np.uint64((1 << 34) - 1) | place
    # Least of every w neighbours: from the left within blocks of w, and from the right.
    m = -(-n // w) * w
    grid = np.full(m, np.uint64(2**64 - 1))
    grid[:n] = h
    del h, place
    grid = grid.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    least = np.minimum(right[:count], left[w - 1 : w - 1 + count])
    del grid, left, right
    anchor = (least & np.uint64((1 << 34) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))[:count]
    whole = np.arange(count) + length <= bounds[text + 1]
    p = np.flatnonzero(whole)
    if not len(p):
        return none, none, none, none
    a, t = anchor[p], text[p]
    begins = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (t[1:] != t[:-1])])
    ends = np.r_[begins[1:], len(p)] - 1
    return t[begins], a[begins], p[begins], p[ends]


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Sorted byte rows as shared lengths and the rests."""
    same = rows[1:] == rows[:-1]
    shared = np.r_[0, np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))] if len(rows) > 1 else np.zeros(1, int)
    keep = np.arange(rows.shape[1]) >= shared[:, None]
    return shared.astype(np.uint8), rows[keep].tobytes()


def front_decode(shared: bytes, rest: bytes, width: int) -> tuple[list[bytes], list[int]]:
    out, at, last = [], 0, b""
    lengths = list(shared)
    for k in lengths:
        last = last[:k] + rest[at : at + width - k]
        at += width - k
        out.append(last)
    return out, lengths


def merge_runs(runs: list[tuple[list[bytes], list[int]]], width: int) -> tuple[list[int], list[int]]:
    """Merge sorted runs of equal-width strings with a loser tree over common-prefix lengths.

    Returns the run of each string in merged order, and the length each shares with the one before.
    """
    k = 1
    while k < max(2, len(runs)):
        k *= 2
    end = width + 1  # shared length of a run that is used up: it loses against all
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    shared = [0] * k
    place = [0] * k
    losers = [0] * k

    def beats(a: int, b: int) -> bool:
        """Whether the head of ``a`` comes first; the loser learns what it shares with it."""
        if heads[a] is None:
            return False
        if heads[b] is None:
            return True
        x, y = shared[a], shared[b]
        if x != y:
            return x > y
        s, t = heads[a], heads[b]
        while x < width and s[x] == t[x]:
            x += 1
        first = x == width and a < b or x < width and s[x] < t[x]
        shared[b if first else a] = x
        return first

    winners = [0] * (2 * k)
    winners[k:] = range(k)
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    top = winners[1]
    order, common = [], []
    while heads[top] is not None:
        order.append(top)
        common.append(shared[top])
        place[top] += 1
        strings, lengths = runs[top]
        i = place[top]
        if i < len(strings):
            heads[top], shared[top] = strings[i], lengths[i]
        else:
            heads[top], shared[top] = None, end
        node = (k + top) // 2
        while node:
            # The inlined common case: different shared lengths decide without bytes.
            other = losers[node]
            if heads[other] is not None:
                x, y = shared[top], shared[other]
                if heads[top] is None or (y > x if x != y else not beats(top, other)):
                    losers[node], top = top, other
            node //= 2
    return order, common


def _first_of_each(key: tuple[np.ndarray, ...], order: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by key and order, and which of them begin a new key."""
    by = np.lexsort([*order[::-1], *key[::-1]])
    new = np.zeros(len(by), bool)
    if len(by):
        new[0] = True
        for c in key:
            s = c[by]
            new[1:] |= s[1:] != s[:-1]
    return by, new


_SENT = "bucket int, shared binary, rest binary, stretch binary, row binary, doc binary, lo binary, hi binary, gone_row binary, gone_lo binary, gone_hi binary"
_GONE = "row long, lo int, hi int, doc long, open boolean"


def _i8(x) -> bytes:
    return np.ascontiguousarray(np.asarray(x, "<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_i8(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).reshape(-1).view("<i8")


def repeats(docs: DataFrame, buckets: int, length: int = LENGTH, prefix: int = PREFIX) -> DataFrame:
    """Rows (row, lo, hi) of bytes to remove. ``docs``: row (unique), doc_id, text; stored."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _SLICE):
            raw, bounds = _texts(batch)
            t, a, lo, hi = anchors(raw, bounds, length, prefix)
            if not len(t):
                continue
            view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
            stretch = np.array([digest(view[i : j + length], k) for i, j, k in zip(lo.tolist(), hi.tolist(), (a - lo).tolist())], np.uint64)
            row = batch.column("row").to_numpy()[t]
            doc = batch.column("doc_id").to_numpy()[t]
            lo, hi = lo - bounds[t], hi - bounds[t] + length
            suffix = raw[a[:, None] + np.arange(prefix)]
            by, new = _first_of_each((stretch,), (doc, row, lo))
            gone, by = by[~new], by[new]
            words = suffix[by].view(">u8")
            order = np.lexsort(words.T[::-1])
            by, words = by[order], words[order].astype(np.uint64)
            mix = np.zeros(len(by), np.uint64)
            for c in range(words.shape[1]):
                mix = (mix ^ words[:, c]) * _MULT
                mix ^= mix >> np.uint64(31)
            to = (mix % np.uint64(buckets)).astype(np.int64)
            out = {c.split()[0]: [] for c in _SENT.split(", ")}
            placed = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[placed], np.arange(buckets + 1))
            for b in range(buckets):
                some = by[placed[cuts[b] : cuts[b + 1]]]
                if len(some):
                    shared, rest = front_code(suffix[some])
                    values = (b, shared.tobytes(), rest, stretch[some].tobytes(), _i8(row[some]), _i8(doc[some]), _i8(lo[some]), _i8(hi[some]), b"", b"", b"")
                    for c, v in zip(out.values(), values):
                        c.append(v)
            if len(gone):
                for c, v in zip(out.values(), (-1, b"", b"", b"", b"", b"", b"", b"", _i8(row[gone]), _i8(lo[gone]), _i8(hi[gone]))):
                    c.append(v)
            kinds = [pa.int32(), *[pa.binary()] * 10]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    def judge(table: pa.Table) -> pa.Table:
        parts = table.to_pylist()
        if parts[0]["bucket"] < 0:
            row, lo, hi = (np.concatenate([_from_i8(p[c]) for p in parts]) for c in ("gone_row", "gone_lo", "gone_hi"))
            return _gone(row, lo, hi, np.zeros(len(row), np.int64), np.zeros(len(row), bool))
        runs = [front_decode(p["shared"], p["rest"], prefix) for p in parts]
        order, common = merge_runs(runs, prefix)
        sizes = [len(r[0]) for r in runs]
        # Each run's entries come out in their own order.
        order = np.array(order)
        nth = np.empty(len(order), np.int64)
        for r in range(len(runs)):
            nth[order == r] = np.arange(sizes[r])
        pick = np.cumsum([0, *sizes])[order] + nth
        group = np.cumsum(np.array(common) < prefix)
        stretch = np.concatenate([np.frombuffer(p["stretch"], np.uint64) for p in parts])[pick]
        row, doc, lo, hi = (np.concatenate([_from_i8(p[c]) for p in parts])[pick] for c in ("row", "doc", "lo", "hi"))
        by, new = _first_of_each((group, stretch), (doc, row, lo))
        classes = np.bincount(group[by[new]], minlength=group.max() + 1)
        again = by[~new]
        firsts = by[new]
        open_ = firsts[classes[group[firsts]] > 1]
        at = np.concatenate([again, open_])
        return _gone(row[at], lo[at], hi[at], doc[at], np.arange(len(at)) >= len(again))

    def _gone(row, lo, hi, doc, open_) -> pa.Table:
        return pa.table({"row": pa.array(row), "lo": pa.array(lo.astype(np.int32)), "hi": pa.array(hi.astype(np.int32)), "doc": pa.array(doc), "open": pa.array(open_)})

    sent = docs.mapInArrow(send, _SENT)
    spread = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("gone_row"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket"))
    found = durable(sent.withColumn("bucket", spread).groupBy("bucket").applyInArrow(judge, _GONE))

    stretches = found.where("open").groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))
    texts = docs.join(stretches, "row")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in slices(batches, _SLICE):
            rows = batch.column("row").to_pylist()
            ids = batch.column("doc_id").to_pylist()
            keys, row, doc, place = [], [], [], []
            for r, d, text, parts in zip(rows, ids, batch.column("text").to_pylist(), batch.column("parts").to_pylist()):
                view = memoryview((text or "").encode())
                for part in parts:
                    starts = range(part["lo"], part["hi"] - length + 1)
                    keys += [digest(view[i : i + length]) for i in starts]
                    place += starts
                    row += [r] * len(starts)
                    doc += [d] * len(starts)
            if not keys:
                continue
            key = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
            row, doc, place = np.array(row, np.int64), np.array(doc, np.int64), np.array(place, np.int64)
            by, new = _first_of_each((key[:, 0], key[:, 1]), (doc, row, place))
            gone, by = by[~new], by[new]
            to = (key[by, 0] % np.uint64(buckets)).astype(np.int64)
            by = by[np.argsort(to, kind="stable")]
            cuts = np.searchsorted(np.sort(to), np.arange(buckets + 1))
            out: list[tuple] = []
            for b in range(buckets):
                some = by[cuts[b] : cuts[b + 1]]
                if len(some):
                    some = some[np.lexsort((place[some], row[some]))]
                    out.append((b, key[some].tobytes(), _i8(row[some]), _i8(doc[some]), _i8(place[some])))
            if len(gone):
                out.append((-1, b"", _i8(row[gone]), _i8(doc[gone]), _i8(place[gone])))
            kinds = [pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], ["bucket", "key", "row", "doc", "place"]
            )

    def compare(table: pa.Table) -> pa.Table:
        parts = table.to_pylist()
        row, doc, place = (np.concatenate([_from_i8(p[c]) for p in parts]) for c in ("row", "doc", "place"))
        if parts[0]["bucket"] >= 0:
            key = np.concatenate([np.frombuffer(p["key"], "<u8") for p in parts]).reshape(-1, 2)
            by, new = _first_of_each((key[:, 0], key[:, 1]), (doc, row, place))
            row, place = row[by[~new]], place[by[~new]]
        # Neighbouring windows of a text are one piece.
        by = np.lexsort((place, row))
        row, place = row[by], place[by]
        begins = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (place[1:] > place[:-1] + length)]) if len(row) else np.zeros(0, int)
        ends = np.r_[begins[1:], len(row)] - 1 if len(row) else begins
        return pa.table({"row": pa.array(row[begins]), "lo": pa.array(place[begins].astype(np.int32)), "hi": pa.array((place[ends] + length).astype(np.int32))})

    keyed = texts.select("row", "doc_id", "text", "parts").mapInArrow(windows, "bucket int, key binary, row binary, doc binary, place binary")
    spread = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket"))
    single = keyed.withColumn("bucket", spread).groupBy("bucket").applyInArrow(compare, "row long, lo int, hi int")
    return found.where("not open").select("row", "lo", "hi").unionByName(single)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the
    remaining bytes, which may split a character).

    ``docs`` has to be a stored table (or a projection of one): its rows are known by their place.
    A null text is empty; a null id counts as smaller than all others; among rows of one id the one
    stored first is the earlier. Texts shorter than ``length`` bytes stay whole. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = -(1 << 63)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(docs[id_col].cast("long"), F.lit(least)).alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )
    spans = repeats(rows, buckets, length).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw, kept, at, runs, end = text.encode(), [], 0, 0, -1
                for s in sorted(spans or [], key=lambda s: s["lo"]):
                    if s["lo"] > end:
                        kept.append(raw[at : s["lo"]])
                        runs += 1
                    end = max(end, s["hi"])
                    at = end
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((len(raw), len(raw) - len(left), runs, left))
            ids = [None if i == least else i for i in batch.column("doc_id").to_pylist()]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *[pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    joined = rows.join(spans, "row", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(kept: DataFrame) -> DataFrame:
    """``remove_repeats`` with ``kept_sha256`` in place of the bytes."""
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
