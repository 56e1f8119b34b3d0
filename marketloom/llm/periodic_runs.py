"""Runs of words with a period, found in overlapping tiles per octave of periods.

A document of ``n`` words is exploded, for every octave ``P <= q < 2P`` of periods, into tiles around
the boundaries ``0, 2P, 4P, ...``; a tile reaches ``2P`` words back and a little over ``4P`` words on.
Any repetition of a period of the octave that is long enough to count crosses a boundary with at
least ``gram(P)`` words to spare, so only boundaries with such an equal stretch at some distance of
the octave leave a tile. Tiles are solved independently: the Z-function of the words from the
boundary on, and that of the words read backwards from it, say how far the equality at distance
``q`` reaches to both sides. These fragments are shuffled by document and period and stitched where
they overlap. A stretch that is found with several periods has the least of them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.keyed import join_grouped
from marketloom.llm.common import id_and_text, map_texts

KEY = ["_k1", "_k2"]
_TILE = "_k1 long, _k2 long, octave long, boundary long, back long, words binary, periods binary"
_FRAGMENT = "_k1 long, _k2 long, period long, first long, last long"
_RUNS = "array<struct<start:long,length:long,period:long>>"


def least_length(q: int) -> int:
    """Words a run of period ``q`` needs."""
    return max(6, 4 * q)


def gram(octave: int) -> int:
    """Equal words that follow some boundary inside every repetition of the octave that counts.

    The equality at distance ``q`` holds over ``least_length(q) - q`` words, and the first boundary in
    there comes within ``2 * octave`` of them.
    """
    return min(least_length(octave) - octave - 2 * octave + 1, 8)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the repetition that the rule of the query puts into every tenth id."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _words(texts: pa.Array, ids: pa.Array, rule) -> Iterator[list[bytes]]:
    for text, doc_id in zip(texts.cast(pa.binary()).to_pylist(), ids.to_pylist()):
        words = text.split()
        yield rule(words, doc_id) if rule else words


def z_function(s: list[int]) -> list[int]:
    """For every place the length of the longest stretch from there that also begins ``s``."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _nominated(code: np.ndarray, starts: np.ndarray, ends: np.ndarray, octave: int):
    """(boundary, period) pairs, as places in ``code``, with ``gram(octave)`` equal words."""
    g, step = gram(octave), 2 * octave
    open_ = ends - starts >= least_length(octave)
    begin, end = starts[open_], ends[open_]
    count = np.maximum((end - begin - g - octave) // step + 1, 0)
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.repeat(begin, count) + step * (np.arange(total) - np.repeat(np.cumsum(count) - count, count))
    room = np.repeat(end, count) - at - g
    mixed = np.zeros(len(code) - g + 1, np.uint64)
    for t in range(g):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + code[t : len(code) - g + 1 + t]
    places, periods = [], []
    if octave <= total:
        for q in range(octave, 2 * octave):
            here = at[room >= q]
            hit = here[mixed[here] == mixed[here + q]]
            if len(hit):
                places.append(hit)
                periods.append(np.full(len(hit), q))
    else:
        for b, most in zip(at.tolist(), room.tolist()):
            near = mixed[b + octave : b + min(2 * octave - 1, most) + 1]
            hit = np.flatnonzero(near == mixed[b])
            places.append(np.full(len(hit), b))
            periods.append(hit + octave)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b, q = np.concatenate(places), np.concatenate(periods)
    order = np.lexsort((q, b))
    return b[order], q[order]


def _tiles(rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = list(_words(batch.column("text"), batch.column("doc_id"), rule))
            sizes = np.array([len(w) for w in docs], np.int64)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            flat = pa.array([w for words in docs for w in words], pa.binary())
            code = flat.dictionary_encode().indices.to_numpy().astype(np.uint64)
            small = code.astype("<i4")
            k1, k2 = (batch.column(k).to_numpy() for k in KEY)
            octave = 1
            while len(sizes) and least_length(octave) <= sizes.max():
                b, q = _nominated(code, starts, ends, octave)
                octave *= 2
                if not len(b):
                    continue
                p = octave // 2
                heads = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
                doc = np.searchsorted(ends, b[heads], side="right")
                low = np.maximum(starts[doc], b[heads] - 2 * p)
                high = np.minimum(ends[doc], b[heads] + 4 * p + gram(p))
                stops = np.r_[heads[1:], len(b)]
                for lo in range(0, len(heads), 4096):
                    part = slice(lo, lo + 4096)
                    d = doc[part]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(k1[d]),
                            pa.array(k2[d]),
                            pa.array(np.full(len(d), p)),
                            pa.array(b[heads[part]] - starts[d]),
                            pa.array(b[heads[part]] - low[part]),
                            pa.array([small[i:j].tobytes() for i, j in zip(low[part], high[part])], pa.binary()),
                            pa.array([q[i:j].astype("<i8").tobytes() for i, j in zip(heads[part], stops[part])], pa.binary()),
                        ],
                        [*KEY, "octave", "boundary", "back", "words", "periods"],
                    )

    return run


def solve(words: list[int], back: int, octave: int, periods: list[int]) -> list[tuple[int, int, int]]:
    """``(period, before, after)`` per period: words before and from the boundary that equal the
    word ``period`` later. What is whole within the tile and too short to count is left out."""
    reach = 2 * octave + gram(octave)
    ahead = z_function(words[back:])
    mirror = words[: back + 2 * octave][::-1]
    behind = z_function([*words[:back][::-1], -1, *mirror])
    found = []
    for q in periods:
        after = min(ahead[q], reach) if q < len(ahead) else 0
        at = back + 1 + len(mirror) - back - q
        before = behind[at] if at < len(behind) else 0
        cut = after == reach or (before == back and back == 2 * octave)
        if cut or before + after >= least_length(q) - q:
            found.append((q, before, after))
    return found


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of the tiles; those of neighbouring tiles that came together are one already."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            words = np.frombuffer(row["words"], "<i4").tolist()
            periods = np.frombuffer(row["periods"], "<i8").tolist()
            b = row["boundary"]
            for q, before, after in solve(words, row["back"], row["octave"], periods):
                rows.append((row["_k1"], row["_k2"], q, b - before, b + after))
        if rows:
            cols = _joined(np.array(rows, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols.T], [*KEY, "period", "first", "last"])


def _joined(rows: np.ndarray) -> np.ndarray:
    """Rows of key, period, first and last with those that overlap or touch made one."""
    rows = rows[np.lexsort(rows.T[::-1])]
    group = np.cumsum(np.r_[0, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
    far = group * (rows[:, 4].max() + 1)
    reached = np.maximum.accumulate(rows[:, 4] + far)
    opens = np.r_[True, (rows[1:, 3] + far[1:] > reached[:-1]) | (group[1:] != group[:-1])]
    heads = np.flatnonzero(opens)
    out = rows[heads]
    out[:, 4] = np.maximum.reduceat(rows[:, 4], heads)
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id and text with 128 bits that stand for both: equal rows share their runs."""
    slim = id_and_text(docs, id_col, text_col)
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    return slim.withColumn("_k1", F.xxhash64(named, "text")).withColumn("_k2", F.xxhash64(F.lit(1), "text", named))


def runs(keyed: DataFrame, rule=None) -> DataFrame:
    """``_k1, _k2`` and the runs of the document, sorted by start and period."""
    tiles = map_texts(keyed, _tiles(rule), _TILE)
    fragments = map_texts(tiles, _solve, _FRAGMENT).distinct()
    by_period = Window.partitionBy(*KEY, "period").orderBy("first", "last")
    reached = F.max("last").over(by_period.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reached.isNull() | (F.col("first") > reached), 1).otherwise(0)
    stitched = (
        fragments.withColumn("opens", opens)
        .withColumn("stretch", F.sum("opens").over(by_period.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*KEY, "period", "stretch")
        .agg(F.min("first").alias("start"), (F.max("last") - F.min("first")).alias("equal"))
    )
    length = F.col("equal") + F.col("period")
    long = stitched.withColumn("length", length).where(
        F.col("length") >= F.greatest(F.lit(6), 4 * F.col("period"))
    )
    least = long.groupBy(*KEY, "start", "length").agg(F.min("period").alias("period"))
    # Sorted by start and period, as the fields of the struct stand.
    listed = F.sort_array(F.collect_list(F.struct("start", "period", "length")))
    named = F.transform(
        listed,
        lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")),
    )
    return least.groupBy(*KEY).agg(named.alias("runs"))


def periodic_runs(docs: DataFrame, rule=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``text`` and ``runs`` (start, length and period in words).

    Words are runs without ASCII white space. A run is a stretch of at least six words and four
    periods, as long as it can be, with its smallest period. ``rule(words, doc_id)`` may change the
    words first. A null text counts as empty and has no runs, as an empty one; ids may be null or
    repeat, equal rows give equal results, and an empty table an empty one. Texts of any length are
    taken whole: a task holds one text at a time, and its tiles are rows of their own.
    """
    keyed = _keyed(docs, id_col, text_col)
    joined = join_grouped(keyed, runs(keyed, rule), KEY, "left")
    return joined.select("doc_id", "text", F.coalesce("runs", F.from_json(F.lit("[]"), _RUNS)).alias("runs"))


_COLLAPSED = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def collapse(words: list[bytes], found: list[dict]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    keep = np.ones(len(words), bool)
    for r in found:
        keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
    return [words[i] for i in np.flatnonzero(keep)]


def digest(found: DataFrame, rule=None) -> DataFrame:
    """The rows of ``periodic_runs`` as their longest run and hashes of all runs and kept words.

    Of equally long runs the first counts, then the one with the smaller period.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts = _words(batch.column("text"), batch.column("doc_id"), rule)
            for doc_id, words, rs in zip(batch.column("doc_id").to_pylist(), texts, batch.column("runs").to_pylist()):
                best = min(rs, key=lambda r: (-r["length"], r["start"], r["period"]), default=None)
                lines = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in rs)
                kept = b" ".join(collapse(words, rs))
                out.append(
                    (
                        doc_id,
                        len(rs),
                        *((best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]) if best else [None] * 4),
                        hashlib.sha256(lines.encode()).hexdigest(),
                        hashlib.sha256(kept).hexdigest(),
                    )
                )
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            names = [c.split()[0] for c in _COLLAPSED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return map_texts(found, run, _COLLAPSED)
