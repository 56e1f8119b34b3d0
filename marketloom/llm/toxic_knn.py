"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and their first four letters. A bounded sample of labelled rows gives the examples;
all their terms are indexed, each weighted by how far it leans to label 1 (chi-square, bounded, never
zero); document frequencies come from all documents. Words that no example has count in the norm of
a text as words of no document. Every text is read once: its terms are stored as numbers, from which
both the frequencies and the scores are taken.

Examples that share terms stand in the same blocks. A query adds up its rare terms, which have few
postings, and bounds what the common ones can add by their largest weight per block. Blocks are
opened by falling bound until no bound reaches the worst neighbour, so the neighbours are exact. An
example is not its own neighbour.
Their votes, weighted by squared cosine and by the share of their class that was sampled, are drawn
towards the rate of examples without any strongly leaning term, which is also the score of texts
that share no term with an example.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import id_and_text, map_texts
from marketloom.session import durable

# Labelled rows per class that the index holds at most.
EXAMPLES = 2000
# Chi-square at which a term weighs half as much as it can; the weight of terms that do not lean.
MIN_CHI = 40.0
LEAST_LEAN = 0.02
COMMON = 16  # terms in more than one of so many examples are held by blocks
NEIGHBOURS = 25
BLOCK = 32
QUERIES = 128  # documents that are searched together
PRIOR = 1.0
_WORD = re.compile(r"[^\W\d_]{2,}")
_VECTORS = "doc_id long, terms array<int>, counts array<int>, rest double"


def term_counts(text: str) -> Counter:
    """Counts of words (as they are) and of prefixes (with a trailing star)."""
    words = Counter(_WORD.findall(text.lower()))
    for w, n in list(words.items()):
        if len(w) > 4:
            words[w[:4] + "*"] += n
    return words


def grouped(term: np.ndarray, place: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """An order of the examples in which those that share heavy terms stand together.

    A few rounds of assigning to the nearest mean, over terms folded into 256 sums. The order only
    decides how many blocks a query opens.
    """
    width, means = 256, max(1, size // BLOCK)
    folded = np.bincount(place * width + (term * 2654435761 >> 8) % width, value, size * width)
    x = folded.reshape(size, width) / (np.linalg.norm(folded.reshape(size, width), axis=1, keepdims=True) + 1e-12)
    centre = x[np.linspace(0, size - 1, means).astype(int)]
    for _ in range(6):
        near = x @ centre.T
        group = near.argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, group, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / (norm + 1e-12), centre)
    return np.lexsort((near.max(1), group))


class Postings:
    """Normed weights per term and example. Common terms lie in blocks of examples, with their
    largest weight per block; the others, a few entries each, in lists."""

    def __init__(self, n_terms: int, size: int, term: np.ndarray, place: np.ndarray, value: np.ndarray):
        blocks = max(1, -(-size // BLOCK))
        self.size = blocks * BLOCK
        self.opened = 0  # blocks opened so far
        count = np.bincount(term, minlength=n_terms)
        common = np.flatnonzero(count * COMMON > size)
        self.row = np.full(n_terms, -1, np.int32)
        self.row[common] = np.arange(len(common))
        inside = self.row[term] >= 0
        self.matrix = np.zeros((blocks, len(common), BLOCK), np.float32)
        self.matrix[place[inside] // BLOCK, self.row[term[inside]], place[inside] % BLOCK] = value[inside]
        self.block_max = np.ascontiguousarray(self.matrix.max(axis=2).T)
        term, place, value = term[~inside], place[~inside], value[~inside]
        order = np.argsort(term, kind="stable")
        self.place, self.value = place[order].astype(np.int32), value[order].astype(np.float32)
        self.start = np.r_[0, np.cumsum(np.bincount(term, minlength=n_terms))]

    def search(
        self, ends: np.ndarray, places: np.ndarray, w: np.ndarray, k: int, but: np.ndarray
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the examples, all but ``but``, that hold the ``k`` largest cosines above zero and
        perhaps a few more, with their cosines.

        Query i has the weights ``w`` at the terms ``places`` from ``ends[i]`` to ``ends[i + 1]``. A
        block is opened for all queries of the batch at once that its bound does not rule out.
        """
        m = len(ends) - 1
        query = np.repeat(np.arange(m), np.diff(ends))
        row = self.row[places]
        rare = row < 0
        first = self.start[places[rare]]
        n = self.start[places[rare] + 1] - first
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        cell = np.repeat(query[rare] * self.size, n) + self.place[at]
        cos = np.bincount(cell, np.repeat(w[rare], n) * self.value[at], m * self.size).reshape(m, -1, BLOCK)
        q = np.zeros((m, len(self.block_max)), np.float32)
        q[query[~rare], row[~rare]] = w[~rare]
        bound = cos.max(axis=2) + q @ self.block_max
        order = np.argsort(-bound, axis=1, kind="stable")
        rank = np.empty(bound.shape, np.int64)
        np.put_along_axis(rank, order, np.arange(bound.shape[1])[None], axis=1)
        value = np.full((m, self.size), -1.0, np.float32)
        done, worst = np.zeros(bound.shape, bool), np.full(m, 1e-9)
        step = max(2, -(-2 * k // BLOCK))
        own = np.flatnonzero(but >= 0)
        while True:
            # A margin for single precision: a block at the worst neighbour's value is still opened.
            open_ = ~done & (rank < step) & (bound > 0) & (bound >= worst[:, None] - 1e-5)
            for b in np.flatnonzero(open_.any(axis=0)).tolist():
                of = np.flatnonzero(open_[:, b])
                value[of, b * BLOCK : (b + 1) * BLOCK] = cos[of, b] + q[of] @ self.matrix[b]
            value[own, but[own]] = -1.0
            done |= open_
            self.opened += int(open_.sum())
            if step >= bound.shape[1]:
                break
            # The worst neighbour among the blocks of the highest bounds.
            seen = value.reshape(cos.shape)[np.arange(m)[:, None], order[:, :step]].reshape(m, -1)
            worst = np.maximum(worst, np.partition(seen, -k, axis=1)[:, -k])
            step *= 4
        out = []
        for i in range(m):
            kept = np.flatnonzero(value[i] >= max(worst[i] - 1e-5, 1e-9))
            if len(kept) > k:
                kept = kept[value[i, kept] >= np.partition(value[i, kept], -k)[-k] - 1e-5]
            mine = slice(ends[i], ends[i + 1])
            has = ~rare[mine]
            block, inside = kept // BLOCK, kept % BLOCK
            # Again in double precision, so that a value does not depend on the batch.
            dense = self.matrix[block[:, None], row[mine][has], inside[:, None]] * w[mine][has]
            out.append((kept, cos[i].ravel()[kept] + dense.sum(axis=1)))
        return out


@dataclass(frozen=True)
class Index:
    terms: dict[str, int]
    idf: np.ndarray  # per term, with its lean
    weights: Postings
    votes: np.ndarray  # per place: weight of the example's vote
    labels: np.ndarray
    ids: np.ndarray
    base: float  # rate of label 1 among examples without strongly leaning terms
    unseen: float = 0.0  # weight of a word that no example has

    def nearest(
        self, ends: np.ndarray, places: np.ndarray, w: np.ndarray, k: int, but: np.ndarray
    ) -> list[list[tuple[float, int]]]:
        """Per query (cosine, place) of the ``k`` nearest examples that share a term; ties by place."""
        out = []
        for kept, values in self.weights.search(ends, places, w, k, but):
            best = np.lexsort((kept, -np.round(values, 9)))[:k]
            out.append(list(zip(values[best].tolist(), kept[best].tolist())))
        return out

    def scores(
        self, ends: np.ndarray, places: np.ndarray, counts: np.ndarray, rest: np.ndarray, but: np.ndarray, k: int = NEIGHBOURS
    ) -> list[tuple[float, list[int]]]:
        """The scores of rows of ``term_vectors`` and the ids of their nearest examples."""
        w = (1.0 + np.log(counts)) * self.idf[places]
        query = np.repeat(np.arange(len(rest)), np.diff(ends))
        norm = np.bincount(query, w * w, len(rest)) + rest * self.unseen**2
        w = w / np.sqrt(norm)[query]
        out = []
        for best in self.nearest(ends, places, w, k, but):
            total = vote = 0.0
            for cos, i in best:
                v = cos * cos * self.votes[i]
                total += v
                vote += v * self.labels[i]
            rate = (vote + PRIOR * self.base) / (total + PRIOR)
            out.append((min(1.0, max(0.0, float(rate))), [int(self.ids[i]) for _, i in best[:3]]))
        return out


def training_rows(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """``doc_id``, ``label`` of the rows whose crc32 of the id, modulo 3, is not 1; each id once
    (the larger label counts), null ids and labels other than 0 and 1 left out."""
    rows = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label"))
    rows = rows.where("doc_id is not null and label in (0, 1)")
    rows = rows.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def term_vectors(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """One row per row of ``doc_id, text``: the numbers of its terms, rising, their counts, and in
    ``rest`` the sum of (1 + log count)^2 over its terms that have no number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Word to the numbers of itself and of its prefix; forgotten when it grows large.
        numbers: dict[str, tuple[int, int]] = {}
        for batch in batches:
            if len(numbers) > 200_000:
                numbers.clear()
            flat, counts, ends, rests = [], [], [0], []
            for text in batch.column("text").to_pylist():
                found: dict[int, int] = {}
                unknown: dict[str, int] = {}
                for w, n in Counter(_WORD.findall(text.lower())).items():
                    pair = numbers.get(w)
                    if pair is None:
                        pair = numbers[w] = (terms.get(w, -1), terms.get(w[:4] + "*", -1) if len(w) > 4 else -2)
                    one, two = pair
                    if one >= 0:
                        found[one] = n
                    else:
                        unknown[w] = n
                    if two >= 0:
                        found[two] = found.get(two, 0) + n
                    elif two == -1:
                        unknown[w[:4] + "*"] = unknown.get(w[:4] + "*", 0) + n
                places = sorted(found)
                flat += places
                counts += [found[p] for p in places]
                ends.append(len(flat))
                rests.append(sum((1 + log(n)) ** 2 if n > 1 else 1.0 for n in unknown.values()))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32())),
                    pa.array(rests, pa.float64()),
                ],
                ["doc_id", "terms", "counts", "rest"],
            )

    return map_texts(docs, run, _VECTORS)


def frequencies(vectors: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """Documents per term, and documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms + 1, np.int64)
        for batch in batches:
            df[:-1] += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
            df[-1] += batch.num_rows
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(df[held])], ["i", "n"])

    df = np.zeros(n_terms + 1, np.int64)
    for r in vectors.select("terms").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        df[r["i"]] = r["n"]
    return df[:-1], int(df[-1])


def build(docs: DataFrame, train: DataFrame, examples: int = EXAMPLES) -> tuple[Index, DataFrame]:
    """The index and the stored term vectors of all documents, which ``score_vectors`` takes.

    Examples are chosen by the hash of their id; all their terms are weighed.
    """
    texts = id_and_text(docs)
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = [train.where(F.col("label") == y).orderBy(*order).limit(examples) for y in (0, 1)]
    sample = durable(texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id"))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                found = list(term_counts(text))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([label] * len(found), pa.int32())], ["term", "label"])

    n1 = sample.where("label = 1").count()
    n0 = sample.where("label = 0").count()
    chis: dict[str, float] = {}
    if n0 and n1:
        a, b = F.col("a").cast("double"), F.col("n") - F.col("a").cast("double")
        total = float(n0 + n1)
        chi = total * F.pow(a * n0 - b * n1, 2) / (F.col("n") * F.greatest(F.lit(total) - F.col("n"), F.lit(0.5)) * n0 * n1)
        stats = map_texts(sample, explode, "term string, label int").groupBy("term").agg(
            F.sum("label").alias("a"), F.count("*").alias("n")
        )
        leaning = F.when(a * n0 > b * n1, chi).otherwise(0.0)
        chis = {r["term"]: r["chi"] for r in stats.select("term", leaning.alias("chi")).collect()}
    known = {t: i for i, t in enumerate(sorted(chis))}
    chi_of = np.array([chis[t] for t in known])
    lean = LEAST_LEAN + (1 - LEAST_LEAN) * chi_of**2 / (chi_of**2 + MIN_CHI**2)

    vectors = durable(term_vectors(texts, known))
    df, n_docs = frequencies(vectors, len(known))
    idf = lean * (np.log((1 + n_docs) / (1 + df)) + 1)
    chosen_ids = sample.select("doc_id", "label").distinct()
    rows = term_vectors(sample.select("doc_id", "text"), known).join(F.broadcast(chosen_ids), "doc_id").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["label"], r["terms"], r["counts"], r["rest"]))
    # Each sampled example stands for this many rows of its class.
    stands = {0: sizes.get(0, 0) / max(n0, 1), 1: sizes.get(1, 0) / max(n1, 1)}
    bare = [r["label"] for r in rows if not (chi_of[np.array(r["terms"], int)] >= MIN_CHI).any()]
    mass = sum(stands[y] for y in bare)
    base = sum(stands[1] for y in bare if y) / mass if mass else 0.0
    # Without smoothing an empty class would give certainty.
    base = (base * len(bare) + 0.5 * 0.02) / (len(bare) + 0.02) if bare else 0.5 * (n1 > 0)
    rows = [r for r in rows if r["terms"]]
    size = max(1, len(rows))
    votes, labels, ids = np.zeros(size), np.zeros(size, np.int8), np.zeros(size, np.int64)
    unseen = LEAST_LEAN * (np.log(1 + n_docs) + 1)
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for i, r in enumerate(rows):
        w = (1 + np.log(np.array(r["counts"], float))) * idf[r["terms"]]
        parts.append((np.array(r["terms"]), np.full(len(w), i), w / np.sqrt((w * w).sum())))
        votes[i], labels[i], ids[i] = stands[r["label"]], r["label"], r["doc_id"]
    term, place, value = map(np.concatenate, zip(*parts))
    order = grouped(term, place, value, size)
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    weights = Postings(len(known), size, term, rank[place], value)
    least = max(min((v for v in stands.values() if v), default=1.0), 1e-9)
    index = Index(known, idf, weights, votes[order] / least, labels[order], ids[order], float(base), float(unseen))
    return index, vectors


def score_vectors(vectors: DataFrame, index: Index, threshold: float = 0.7) -> DataFrame:
    """One row per row of ``term_vectors``: ``doc_id``, ``score``, ``predicted``, ``evidence``."""
    index = replace(index, terms={})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {int(d): i for i, d in enumerate(index.ids) if index.votes[i] > 0}
        for batch in batches:
            but = np.array([own.get(d, -1) for d in batch.column("doc_id").to_pylist()], np.int64)
            rest = batch.column("rest").to_numpy()
            ends = batch.column("terms").offsets.to_numpy().astype(np.int64)
            from_ = int(batch.column("counts").offsets[0].as_py())
            places = batch.column("terms").values.to_numpy()[ends[0] : ends[-1]]
            counts = batch.column("counts").values.to_numpy()[from_ : from_ + len(places)]
            ends -= ends[0]
            found = []
            for a in range(0, len(rest), QUERIES):
                b = min(a + QUERIES, len(rest))
                part = slice(ends[a], ends[b])
                found += index.scores(ends[a : b + 1] - ends[a], places[part], counts[part], rest[a:b], but[a:b])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([s for s, _ in found], pa.float64()),
                    pa.array([int(s >= threshold) for s, _ in found], pa.int32()),
                    pa.array([e for _, e in found], pa.list_(pa.int64())),
                ],
                ["doc_id", "score", "predicted", "evidence"],
            )

    return map_texts(vectors, run, "doc_id long, score double, predicted int, evidence array<long>")


def score_documents(
    docs: DataFrame, index: Index, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id``, ``score``, ``predicted``, ``evidence`` (nearest examples).

    Null texts count as empty and get the score of texts without terms; null ids and repeated rows
    are kept; an empty table gives an empty result. A row with the id of an example does not have
    that example among its neighbours.
    """
    return score_vectors(term_vectors(id_and_text(docs, id_col, text_col), index.terms), index, threshold)
