"""Benchmark decontamination by latent semantic retrieval.

The benchmark's passages are the indexed collection: their TF-IDF matrix (document frequencies from
all documents of the corpus) is factored by a distributed randomised SVD. Every window of every
document is folded into the latent space and compared by cosine with all benchmark passages, a
stated query set, in blocks of ``BLOCK`` passages. A window whose words, each at the most it can add
to any passage, stay below the threshold is dropped before it is folded. Beside it an exact search
by counts finds what the cosine does not: of a passage's rarest words so many must stand together
in any stretch that can hold enough of it, whatever their weights. Candidates of both
are judged by the longest common subsequence of words: a copy has ``copy_share`` of the passage, a
paraphrase ``para_share`` of it and also the passage's answer (its last sentence).

The basis is fitted on the benchmark and not on the corpus: directions that are common in the corpus
say nothing about rare words, by which passages are found. With ``rank`` at or above the number of
passages the latent cosine is the plain one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import id_and_text, slices
from marketloom.session import durable

BLOCK = 256
RANK = 256
STRIDE, SPAN = 8, 4  # a window is SPAN strides of STRIDE words
PASSAGE = 64  # longer items are cut into passages of so many words
MIN_WORDS = 5  # shorter items are in every text and are not looked for
MIN_COSINE = 0.3
COPY_SHARE, PARA_SHARE = 0.8, 0.6
STRETCH = 2  # a copy with its insertions has at most so many times the words of its passage
# Weights of a word that is in all documents and in none; words outside the benchmark's vocabulary
# are not counted and weigh as words of this rarity do.
LEAST_WEIGHT, MOST_WEIGHT, OTHER_RARITY = 0.25, 2.0, 0.7
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.?!\n]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def passages_of(item_id: int, text: str) -> list[tuple[int, list[str], list[str]]]:
    """(item, words, answer) of an item; the answer is its last sentence of three words or more,
    else its last quarter. Only the last of several passages has the item's answer."""
    words = words_of(text)
    if len(words) < MIN_WORDS:
        return []
    n = -(-len(words) // PASSAGE)
    cuts = [len(words) * i // n for i in range(n + 1)]
    parts = [words[a:b] for a, b in zip(cuts, cuts[1:])]
    sentences = [s for s in map(words_of, _SENTENCE.split(text)) if len(s) >= 3]
    quarter = lambda p: p[-max(3, len(p) // 4) :]
    last = sentences[-1] if sentences else quarter(words)
    return [(item_id, p, last if i == n - 1 else quarter(p)) for i, p in enumerate(parts)]


def common_subsequence(passage: list[str], region: list[str]) -> int:
    """Length of the longest common subsequence, a row of bits per word of the region."""
    masks: dict[str, int] = {}
    for i, w in enumerate(passage):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(passage)) - 1
    row = full
    for w in region:
        m = masks.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(passage) - row.bit_count()


def randomised_svd(rows: DataFrame, width: int, rank: int, extra: int = 10, seed: int = 7) -> np.ndarray:
    """Right singular vectors (``width`` x at most ``rank``) of a sparse matrix.

    ``rows``: ``terms`` array<int>, ``weights`` array<double>, dealt out over the cluster. Each pass
    multiplies the rows held by a task and adds up the tasks' products in chunks; what reaches the
    driver has ``width`` x (``rank`` + ``extra``) numbers, whatever the number of rows.
    """
    size = min(width, rank + extra)

    def product(right: np.ndarray, gram: bool) -> np.ndarray:
        """``A' A right``, or with ``gram`` ``(A right)' (A right)``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((right.shape[1] if gram else width, right.shape[1]))
            for batch in batches:
                for t, w in zip(batch.column("terms").to_pylist(), batch.column("weights").to_pylist()):
                    if not t:
                        continue
                    y = np.array(w) @ right[t]
                    if gram:
                        out += np.outer(y, y)
                    else:
                        out[t] += np.outer(w, y)
            step = 1024
            at = range(0, len(out), step)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(at), pa.int32()), pa.array([out[i : i + step].tobytes() for i in at], pa.binary())], ["at", "part"]
            )

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(p) for p in table.column("part").to_pylist())
            return pa.table({"at": table.column("at")[:1], "part": pa.array([total.tobytes()], pa.binary())})

        sums = rows.mapInArrow(run, "at int, part binary").groupBy("at").applyInArrow(add, "at int, part binary")
        found = sorted((r["at"], r["part"]) for r in sums.collect())
        return np.concatenate([np.frombuffer(p) for _, p in found]).reshape(-1, right.shape[1])

    basis = np.random.default_rng(seed).normal(size=(width, size))
    for _ in range(3):
        basis, _ = np.linalg.qr(product(basis, gram=False))
    values, turns = np.linalg.eigh(product(basis, gram=True))
    order = np.argsort(-values)[:rank]
    return basis @ turns[:, order[values[order] > 1e-9 * max(values.max(), 1e-30)]]


def _weight(df: int, n: int) -> float:
    """Inverse document frequency on a bounded scale: a benchmark passage that has leaked into a
    third of all documents must not lose its weight against the words around it."""
    rarity = np.log((n + 1) / (df + 1)) / np.log(n + 1) if n else 1.0
    return float(LEAST_WEIGHT + (MOST_WEIGHT - LEAST_WEIGHT) * rarity)


class Searcher:
    """A block of benchmark passages, ready to be looked for in texts."""

    def __init__(self, passages, vocabulary: dict[str, int], idf: np.ndarray, rare: float, basis: np.ndarray):
        self.passages, self.vocabulary = passages, vocabulary
        self.fold = (idf[:, None] * basis).astype(np.float32)  # a word's share of a latent vector
        self.padded = np.vstack([self.fold, np.zeros((1, self.fold.shape[1]), np.float32)])
        self.square = np.r_[idf**2, rare**2, 0.0]  # known words, other words, padding
        latent = np.zeros((len(passages), basis.shape[1]), np.float32)
        norms = np.zeros(len(passages))
        for i, (_, words, _) in enumerate(passages):
            t, n = np.unique([vocabulary[w] for w in words], return_counts=True)
            latent[i] = n @ self.fold[t]
            norms[i] = np.sqrt(((n * idf[t]) ** 2).sum())
        self.latent = latent / np.maximum(norms, 1e-30)[:, None].astype(np.float32)
        # The most that one occurrence of a word can add to the product with any passage.
        most = np.maximum(self.fold @ self.latent.T, 0.0).max(axis=1, initial=0.0)
        self.most = np.r_[most, 0.0, 0.0].astype(float)
        self.rarity = idf
        self._calls: tuple | None = None

    def _encode(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ids of all documents, each filled up to whole strides; first stride and strides of each."""
        get, n = self.vocabulary.get, len(self.vocabulary)
        ids, first, sizes = [], [], []
        for words in docs:
            first.append(len(ids) // STRIDE)
            ids += [get(w, n) for w in words]
            ids += [n + 1] * (-len(ids) % STRIDE)
            sizes.append(len(ids) // STRIDE - first[-1])
        return np.array(ids, np.int64), np.array(first, np.int64), np.array(sizes, np.int64)

    def _calling(self, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per word, as ``start`` and ``flat``, the passages it calls; per passage the least number of
        calling words in a stretch that holds the share ``least`` of it, and the length of a stretch.

        A stretch that lacks at most k of a passage's words holds at least t of any k + t of them;
        the rarest ones are taken, which decides the cost and not the outcome.
        """
        if self._calls is None or self._calls[0] != least:
            called: list[list[int]] = [[] for _ in range(len(self.vocabulary) + 2)]
            needed, length = np.zeros(len(self.passages), np.int64), np.zeros(len(self.passages), np.int64)
            for p, (_, words, _) in enumerate(self.passages):
                m = len(words)
                lacking = max(k for k in range(m) if k == 0 or (m - k) / m >= least)
                needed[p], length[p] = min(m - lacking, max(2, m // 4)), STRETCH * m
                rarest = sorted((self.vocabulary[w] for w in words), key=lambda i: (-self.rarity[i], i))
                for i in set(rarest[: lacking + needed[p]]):
                    called[i].append(p)
            start = np.cumsum([0, *map(len, called)])
            self._calls = (least, start, np.array([p for ps in called for p in ps], np.int64), needed, length)
        return self._calls[1:]

    def called(self, encoded: tuple[np.ndarray, np.ndarray, np.ndarray], least: float):
        """(document, first word, last word, passage) of all regions in which a stretch can hold the
        share ``least`` of the passage; none is lost, whatever the words weigh."""
        ids, first, sizes = encoded
        start, flat, needed, length = self._calling(least)
        fan = np.diff(start)[ids] if len(ids) else np.zeros(0, np.int64)
        at = np.flatnonzero(fan)
        if not len(at):
            return
        fan = fan[at]
        word = np.repeat(at, fan)
        place = np.arange(len(word)) - np.repeat(np.cumsum(fan) - fan, fan)
        passage = flat[start[ids[word]] + place]
        doc = np.repeat(np.arange(len(first)), sizes * STRIDE)[word]
        group = doc * len(self.passages) + passage
        order = np.argsort(group, kind="stable")  # words of a group stay in their order
        group, word, passage, doc = group[order], word[order], passage[order], doc[order]
        last = np.arange(len(word)) + needed[passage] - 1
        some = np.flatnonzero(last < len(word))
        last = last[some]
        some_, last = some[keep := (group[last] == group[some]) & (word[last] - word[some] < length[passage[some]])], last[keep]
        begin = first[doc[some_]] * STRIDE
        a = np.maximum(word[last] - length[passage[some_]] + 1 - begin, 0)
        z = word[some_] + length[passage[some_]] - begin
        held = None
        for g, d, p, x, y in zip(group[some_].tolist(), doc[some_].tolist(), passage[some_].tolist(), a.tolist(), z.tolist()):
            if held and held[0] == g and x <= held[3]:
                held[3] = max(held[3], y)
                continue
            if held:
                yield held[1], held[2], held[3], held[4]
            held = [g, d, x, y, p]
        if held:
            yield held[1], held[2], held[3], held[4]

    def cosine(self, words: list[str], passage: int) -> float:
        """Latent cosine of a stretch of words and a passage."""
        n = len(self.vocabulary)
        ids = np.array([self.vocabulary.get(w, n) for w in words], np.int64)
        vector = self.padded[np.minimum(ids, n)].sum(0)
        return float(vector @ self.latent[passage] / np.sqrt(max(self.square[ids].sum(), 1e-30)))

    def candidates(self, docs: list[list[str]], min_cosine: float, encoded: tuple | None = None):
        """(document, first word, last word, passage, cosine) of the windows at ``min_cosine``.

        The norm of a window counts each occurrence by itself, which is never more than its norm
        with repeats added up: the cosine errs upwards, so no candidate is lost.
        """
        n = len(self.vocabulary)
        ids, first, sizes = encoded or self._encode(docs)
        if not len(ids):
            return
        square = self.square[ids].reshape(-1, STRIDE)
        most = self.most[ids].reshape(-1, STRIDE).sum(1)
        run_all, run_most = np.r_[0.0, np.cumsum(square.sum(1))], np.r_[0.0, np.cumsum(most)]
        count = np.where(sizes > 0, np.maximum(1, sizes - SPAN + 1), 0)
        doc = np.repeat(np.arange(len(docs)), count)
        begin = first[doc] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        end = np.minimum(begin + SPAN, first[doc] + sizes[doc])
        mass = run_all[end] - run_all[begin]
        open_ = run_most[end] - run_most[begin] >= min_cosine * np.sqrt(mass) - 1e-6
        open_ &= mass > 0
        doc, begin, end, mass = doc[open_], begin[open_], end[open_], mass[open_]
        for at in range(0, len(doc), 4096):
            some = slice(at, at + 4096)
            b, e = begin[some], end[some]
            need = np.unique(np.concatenate([np.minimum(b + k, e - 1) for k in range(SPAN)]))
            grid = np.minimum(ids.reshape(-1, STRIDE)[need], n)
            block = np.zeros((len(need) + 1, self.padded.shape[1]), np.float32)
            one = np.empty((len(need), self.padded.shape[1]), np.float32)
            for k in range(STRIDE):
                block[:-1] += np.take(self.padded, grid[:, k], axis=0, out=one, mode="clip")
            vector = np.zeros((len(b), self.padded.shape[1]), np.float32)
            for k in range(SPAN):
                inside = b + k < e
                vector += block[np.where(inside, np.searchsorted(need, np.minimum(b + k, e - 1)), len(need))]
            cosine = (vector @ self.latent.T) / np.sqrt(mass[some])[:, None].astype(np.float32)
            w, p = np.nonzero(cosine >= min_cosine)
            d = doc[at + w]
            a, z = (b[w] - first[d]) * STRIDE, (e[w] - first[d]) * STRIDE
            yield from zip(d.tolist(), a.tolist(), z.tolist(), p.tolist(), cosine[w, p].tolist())

    def matches(self, texts: list[str], min_cosine: float = MIN_COSINE, copy: float = COPY_SHARE, para: float = PARA_SHARE):
        """Per text the passages found: {item: (share, common, cosine, answer found, first word)}."""
        docs = [words_of(t) for t in texts]
        out: list[dict[int, tuple]] = [{} for _ in docs]
        regions: dict[tuple[int, int], list[list]] = {}
        encoded = self._encode(docs)
        for d, a, b, p, cosine in self.candidates(docs, min_cosine, encoded):
            held = regions.setdefault((d, p), [])
            if held and a <= held[-1][1]:
                held[-1][1] = max(held[-1][1], b)
                held[-1][2] = max(held[-1][2], cosine)
            else:
                held.append([a, b, cosine])
        # The whole passage may reach beyond the windows that showed it.
        stretches = [
            (d, max(0, a - len(self.passages[p][1])), b + len(self.passages[p][1]), p, cosine)
            for (d, p), found in regions.items()
            for a, b, cosine in found
        ]
        stretches += [(*s, None) for s in self.called(encoded, min(copy, para))]
        needs = [Counter(words) for _, words, _ in self.passages]
        for d, a, b, p, cosine in stretches:
            item, words, answer = self.passages[p]
            region = docs[d][a:b]
            inside = needs[p].keys() & region
            if sum(map(needs[p].__getitem__, inside)) < para * len(words):
                continue
            common = common_subsequence(words, region)
            share = common / len(words)
            answered = share >= para and common_subsequence(answer, region) >= copy * len(answer)
            if share >= copy or answered:
                cosine = self.cosine(region, p) if cosine is None else cosine
                best = (share, common, cosine, answered, a)
                out[d][item] = max(out[d].get(item, best), best)
        return out


def searchers(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, block: int = BLOCK, item_col: str = "item_id", text_col: str = "text") -> Iterator[Searcher]:
    """The benchmark in blocks of passages; each reads the corpus once for document frequencies.

    Null ids and texts and items below ``MIN_WORDS`` words are left out, repeated items count once.
    """
    texts = id_and_text(docs)
    items = id_and_text(benchmark, item_col, text_col).where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    items = durable(items)
    held: list = []

    def pages():
        """The items by id, a block of them at a time: one small job each, however many partitions."""
        last = None
        while page := (items if last is None else items.where(F.col("doc_id") > last)).orderBy("doc_id").limit(block).collect():
            yield from page
            last = page[-1]["doc_id"]
            if len(page) < block:
                return

    def ready(passages) -> Searcher:
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, words, _ in passages for w in words}))}

        def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df = np.zeros(len(vocabulary) + 1, np.int64)
            for batch in slices(batches):
                for text in batch.column("text").to_pylist():
                    df[[vocabulary[w] for w in set(words_of(text)) & vocabulary.keys()]] += 1
                    df[-1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(range(len(df)), pa.int32()), pa.array(df)], ["i", "n"])

        counted = texts.select("text").mapInArrow(frequencies, "i int, n long").groupBy("i").agg(F.sum("n").alias("n"))
        df = {r["i"]: r["n"] for r in counted.collect()}
        n = df.get(len(vocabulary), 0)
        idf = np.array([_weight(df.get(i, 0), n) for i in range(len(vocabulary))])
        rare = LEAST_WEIGHT + OTHER_RARITY * (MOST_WEIGHT - LEAST_WEIGHT)
        matrix = []
        for _, words, _ in passages:
            t, c = np.unique([vocabulary[w] for w in words], return_counts=True)
            v = c * idf[t]
            matrix.append((t.tolist(), (v / np.sqrt((v * v).sum())).tolist()))
        spark = docs.sparkSession
        frame = spark.createDataFrame(matrix, "terms array<int>, weights array<double>")
        basis = randomised_svd(frame, len(vocabulary), rank)
        return Searcher(passages, vocabulary, idf, rare, basis)

    for row in pages():
        held += passages_of(row["doc_id"], row["text"])
        while len(held) >= block:
            yield ready(held[:block])
            held = held[block:]
    if held:
        yield ready(held)


_FOUND = "doc_id long, item_id long, share double, common_words long, cosine double, answer_found boolean, first_word long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, block: int = BLOCK, **limits) -> DataFrame:
    """One row per document and benchmark item found in it, clean documents have none.

    A null text counts as empty and holds nothing; rows with a null id are searched and reported
    with it; rows that repeat an id are reported as one. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], _FOUND)
    for searcher in searchers(docs, benchmark, rank, block):

        def run(batches: Iterator[pa.RecordBatch], searcher=searcher) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 2 << 20):
                ids = batch.column("doc_id").to_pylist()
                found = searcher.matches(batch.column("text").to_pylist(), **limits)
                rows = [(i, item, *m) for i, ms in zip(ids, found) for item, m in sorted(ms.items())]
                names = [c.split()[0] for c in _FOUND.split(", ")]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names
                )

        out = out.unionByName(id_and_text(docs).mapInArrow(run, _FOUND))
    best = F.max(F.struct("share", "common_words", "cosine", "answer_found", "first_word")).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, block: int = BLOCK, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item; judged where they lie."""
    out = docs
    for searcher in searchers(docs, benchmark, rank, block):

        def run(batches: Iterator[pa.RecordBatch], searcher=searcher) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 2 << 20):
                texts = [t or "" for t in batch.column(text_col).to_pylist()]
                yield batch.filter(pa.array([not m for m in searcher.matches(texts)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
