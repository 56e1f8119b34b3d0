"""Stupid-backoff scores of all documents under a language model of all documents.

The corpus is the model: n-gram counts are taken over every text, and a document is scored with its
own occurrences left out, so that a text without any like it backs off. Counting is relational, on
hashed n-grams: each batch of documents asks for its distinct n-grams once, with its own counts, as
rows partitioned by hash; a partition is a slice of the count tables, adds up what all batches ask
for, and answers each of them in the order asked; the answers join the batch's exploded n-grams, and
scores are summed per document. A word that stands in every document is asked for once per batch,
so no partition holds more of it than there are batches.

N-grams are told apart by 64-bit hashes; two n-grams that collide share a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import id_and_text, slices

ORDER = 2
BACKOFF = 0.4
BATCH_BITS = 10  # documents of a batch, as a power of two
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ALL = np.uint64(0)  # asked for by every batch: the number of words


class _Hashes(dict):
    """Hash by word, kept between texts; only speed depends on what is kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 1) or 1
        return h


_HASHES = _Hashes()


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = (left * _MIX) ^ (right + (left >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return np.maximum(x ^ (x >> np.uint64(29)), np.uint64(1))


class Batch:
    """The n-grams of some texts: per order the hash that ends at each word, zero where none does."""

    def __init__(self, texts: list[str], order: int):
        words, sizes = [], []
        for t in texts:
            w = t.encode().lower().split()
            words += map(_HASHES.__getitem__, w)
            sizes.append(len(w))
        self.sizes = np.array(sizes, np.int64)
        word = np.array(words, np.uint64)
        starts = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        place = np.arange(len(word)) - np.repeat(starts, self.sizes)
        self.grams = [word]
        for k in range(1, order):
            longer = np.zeros_like(word)
            at = np.flatnonzero(place >= k)
            longer[at] = _mixed(self.grams[-1][at - 1], word[at])
            self.grams.append(longer)
        every = np.concatenate([g[g > 0] for g in self.grams])
        self.asked, self.counts = np.unique(every, return_counts=True)
        self.asked = np.r_[_ALL, self.asked]
        self.counts = np.r_[len(word), self.counts]

    def scores(self, totals: np.ndarray, backoff: float) -> tuple[np.ndarray, np.ndarray]:
        """Per document the sum of log scores, and how many words were scored at the top order."""
        others = [self._others(g, totals) for g in self.grams]
        words_left = (totals[0] - self.sizes)[self.doc]
        # A word that no other document has counts like one occurrence among one word more.
        score = np.log(backoff ** len(self.grams)) - np.log(words_left + 1.0)
        for k, count in enumerate(others):
            if k == 0:
                context = words_left
            else:
                context = np.r_[0, others[k - 1][:-1]]
            seen = count > 0
            value = np.log(np.where(seen, count, 1)) - np.log(np.where(seen, np.maximum(context, 1), 1))
            score = np.where(seen, (len(self.grams) - 1 - k) * np.log(backoff) + value, score)
        top = (others[-1] > 0).astype(np.int64)
        n = len(self.sizes)
        return np.bincount(self.doc, score, n), np.bincount(self.doc, top, n).astype(np.int64)

    def _others(self, gram: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Per word the count of its n-gram in all other documents; zero where it has none."""
        out = np.zeros(len(gram), np.int64)
        at = np.flatnonzero(gram > 0)
        if len(at):
            place = np.searchsorted(self.asked, gram[at])
            pair, back, own = np.unique(self.doc[at] * len(self.asked) + place, return_inverse=True, return_counts=True)
            out[at] = totals[place] - own[back]
        return out


def _planes(x: np.ndarray) -> bytes:
    """Bytes of the same rank together: leading zeros compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def _pack(hashes: np.ndarray) -> bytes:
    return _planes(np.diff(hashes, prepend=np.uint64(0)))


def _unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(raw, "<u8"), dtype=np.uint64)


def score_documents(
    docs: DataFrame,
    order: int = ORDER,
    backoff: float = BACKOFF,
    buckets: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``log_score`` (sum over its words),
    ``mean_log_score`` (null without words) and ``n_top`` (words scored at the top order).

    ``docs`` has to be a stored table (or a projection of one): batches are stretches of its
    partitions, and both readings have to see the same ones. ``buckets`` are the slices of the count
    tables, by default four per shuffle partition. Null texts count as empty and score zero; null
    ids and repeated rows are documents of their own; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = id_and_text(docs, id_col, text_col).withColumn(
        "batch", F.shiftright(F.monotonically_increasing_id(), BATCH_BITS)
    )
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        now = None

        def rows() -> pa.RecordBatch:
            own = Batch(held, order)
            cuts = [0, *np.searchsorted(own.asked, edges).tolist(), len(own.asked)]
            some = [i for i in range(buckets) if cuts[i + 1] > cuts[i]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int32()),
                    pa.array([now] * len(some), pa.int64()),
                    pa.array([_pack(own.asked[cuts[i] : cuts[i + 1]]) for i in some], pa.binary()),
                    pa.array([_planes(own.counts[cuts[i] : cuts[i + 1]].astype("<u4")) for i in some], pa.binary()),
                ],
                ["bucket", "batch", "hashes", "counts"],
            )

        for piece in slices(batches):
            for b, text in zip(piece.column("batch").to_pylist(), piece.column("text").to_pylist()):
                if b != now and held:
                    yield rows()
                    held = []
                now = b
                held.append(text)
        if held:
            yield rows()

    def add(table: pa.Table) -> pa.Table:
        asked = [_unpack(x) for x in table.column("hashes").to_pylist()]
        counts = np.concatenate([_from_planes(x, "<u4") for x in table.column("counts").to_pylist()])
        _, back = np.unique(np.concatenate(asked), return_inverse=True)
        totals = np.bincount(back, counts).astype(np.uint64)[back]
        cuts = np.cumsum([0, *map(len, asked)])
        return pa.table(
            {
                "bucket": table.column("bucket"),
                "batch": table.column("batch"),
                "totals": pa.array([_planes(totals[a:b].astype("<u8")) for a, b in zip(cuts, cuts[1:])], pa.binary()),
            }
        )

    def join(texts: pa.Table, answers: pa.Table) -> pa.Table:
        parts = sorted(zip(answers.column("bucket").to_pylist(), answers.column("totals").to_pylist()))
        totals = np.concatenate([_from_planes(raw, "<u8") for _, raw in parts]).astype(np.int64)
        own = Batch(texts.column("text").to_pylist(), order)
        log_score, top = own.scores(totals, backoff)
        mean = [s / n if n else None for s, n in zip(log_score.tolist(), own.sizes.tolist())]
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "n_words": pa.array(own.sizes, pa.int64()),
                "log_score": pa.array(log_score, pa.float64()),
                "mean_log_score": pa.array(mean, pa.float64()),
                "n_top": pa.array(top, pa.int64()),
            }
        )

    asked = texts.select("batch", "text").mapInArrow(asks, "bucket int, batch long, hashes binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(add, "bucket int, batch long, totals binary")
    return (
        texts.groupBy("batch")
        .cogroup(answers.groupBy("batch"))
        .applyInArrow(join, "doc_id long, n_words long, log_score double, mean_log_score double, n_top long")
    )
