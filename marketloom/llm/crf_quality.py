"""Quality rules over lines: a linear-chain conditional random field marks content or boilerplate.

Each line with a word is one position of a sequence. Its features are shares of characters and words
and whether the line was seen before in the text; the field adds weights between neighbouring
labels. Viterbi decoding gives the best labelling, and a document is kept if the words of its
content lines are at least ``min_share`` of its words. Plain counts refuse hopeless texts first.

The field is fitted on a bounded sample of documents with a quality label, whose lines take the
label of their document. That teaches what lines of poor documents look like; single lines of good
documents that look so are still marked, and single good lines of poor documents are not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import id_and_text, map_texts

# Rows of labels that the fit reads at most; lines of a piece of their documents.
SAMPLE_DOCS = 1500
PIECE = 64
MIN_SHARE = 0.5
WINDOW = 8

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGITS = bytes(range(48, 58))
_LOUD = b"!?"
_SPACES = " \t\n\x0b\x0c\r"
FEATURES = (
    "bias symbols_some symbols_many upper_many digits_many loud_some loud_many letters_few repeats_some"
    " repeats_many seen short long_words closed"
).split()


def line_features(line: bytes, words: list[bytes], seen: bool) -> tuple[float, ...]:
    n, k = len(line), len(words)
    plain = n - k + 1  # characters of words, about
    symbols = n - len(line.translate(None, _SYMBOLS))
    upper = n - len(line.translate(None, _UPPER))
    digits = n - len(line.translate(None, _DIGITS))
    loud = n - len(line.translate(None, _LOUD))
    letters = n - len(line.translate(None, _LETTERS))
    distinct = len(set(words)) / k
    return (
        1.0,
        float(symbols >= 0.3 * k),
        min(1.0, 4 * symbols / plain),
        float(upper > 0.5 * letters and k > 2),
        min(1.0, 2 * digits / plain),
        float(loud >= 0.3 * k),
        min(1.0, 4 * loud / plain),
        float(letters < 0.6 * plain),
        float(distinct < 0.6 and k > 7),
        float(distinct < 0.3 and k > 7),
        float(seen),
        float(k < 4),
        float(plain > 14 * k),
        float(line.rstrip()[-1:] in b".!?"),
    )


@dataclass(frozen=True)
class Field:
    """Weights by feature and label (0 boilerplate, 1 content), and between neighbouring labels."""

    emission: np.ndarray
    transition: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The best labels of one sequence."""
        n = len(features)
        scores = (features @ self.emission).tolist()
        (t00, t01), (t10, t11) = self.transition.tolist()
        a, b = scores[0]
        back = []
        for x, y in scores[1:]:
            to0, to1 = a + t00 < b + t10, a + t01 < b + t11
            back.append((to0, to1))
            a, b = (b + t10 if to0 else a + t00) + x, (b + t11 if to1 else a + t01) + y
        out = np.zeros(n, np.int8)
        label = int(b >= a)
        for i in range(n - 1, 0, -1):
            out[i] = label
            label = int(back[i - 1][label])
        out[0] = label
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(sequences: list[np.ndarray], labels: list[int], rounds: int = 80, l2: float = 1e-3) -> Field:
    """Maximum likelihood by gradient steps; expectations by the forward-backward recursion.

    Without sequences of both labels all weights but the content bias stay zero: all is content.
    """
    d = len(FEATURES)
    emission, transition = np.zeros((d, 2)), np.zeros((2, 2))
    if len(set(labels)) < 2:
        emission[0, 1] = 1.0
        return Field(emission, transition)
    m, length = len(sequences), max(map(len, sequences))
    x, mask, y = np.zeros((m, length, d)), np.zeros((m, length), bool), np.array(labels)
    for i, s in enumerate(sequences):
        x[i, : len(s)], mask[i, : len(s)] = s, True
    total = mask.sum()
    # Both labels weigh alike, however rare poor documents are.
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())[:, None]
    gold = np.zeros((m, length, 2))
    gold[np.arange(m), :, y] = 1.0
    moments = [np.zeros((d, 2)), np.zeros((d, 2)), np.zeros((2, 2)), np.zeros((2, 2))]
    for step in range(1, rounds + 1):
        e = x @ emission
        forward, backward = np.zeros((m, length, 2)), np.zeros((m, length, 2))
        forward[:, 0] = e[:, 0]
        for t in range(1, length):
            new = _logsum(forward[:, t - 1, :, None] + transition, 1) + e[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        for t in range(length - 2, -1, -1):
            new = _logsum(transition + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
        z = _logsum(forward[:, -1], 1)[:, None, None]
        node = np.exp(forward + backward - z) * mask[..., None]
        pair_mask = (mask[:, 1:] * weight)[..., None, None]
        pair = forward[:, :-1, :, None] + transition + (e + backward)[:, 1:, None, :] - z[..., None]
        pair = (np.exp(np.minimum(pair, 0.0)) * pair_mask).sum((0, 1))
        gold_pair = (gold[:, :-1, :, None] * gold[:, 1:, None, :] * pair_mask).sum((0, 1))
        g_e = np.einsum("mtd,mtk->dk", x, (gold * mask[..., None] - node) * weight[..., None]) / total - l2 * emission
        g_t = (gold_pair - pair) / total - l2 * transition
        for k, (g, w) in enumerate(((g_e, emission), (g_t, transition))):
            one, two = moments[2 * k], moments[2 * k + 1]
            one += 0.1 * (g - one)
            two += 0.01 * (g * g - two)
            w += 0.1 * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
    return Field(emission, transition)


def _sequence(text: bytes) -> tuple[np.ndarray, list[int], int]:
    """Features and word counts of the lines with a word, and how many of them repeat a line."""
    seen: set[bytes] = set()
    features, sizes, repeated = [], [], 0
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            again = line in seen
            seen.add(line)
            repeated += again
            features.append(line_features(line, words, again))
            sizes.append(len(words))
    return np.array(features).reshape(-1, len(FEATURES)), sizes, repeated


def fit_on_labels(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Field:
    """Fit on all lines of at most ``sample`` labelled documents, chosen by the hash of their id.

    Long documents train as consecutive pieces of ``PIECE`` lines, so that one of them does not set
    the width of the arrays; only the step from one piece to the next is left out.
    """
    chosen = (
        labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_sequence(text.encode())[0].ravel().tolist() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.list_(pa.float64()))],
                ["doc_id", "label", "features"],
            )

    texts = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    rows = map_texts(texts, run, "doc_id long, label int, features array<double>").collect()
    rows = sorted(((r.doc_id, r.label, r.features) for r in rows if r.features))
    pieces, of = [], []
    for _, label, f in rows:
        lines = np.array(f).reshape(-1, len(FEATURES))
        cut = [lines[k : k + PIECE] for k in range(0, len(lines), PIECE)]
        pieces += cut
        of += [label] * len(cut)
    return fit(pieces, of)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return 0
    places = np.sort(order[np.r_[same, False] | np.r_[False, same]])
    by: dict[tuple[bytes, ...], list[int]] = {}
    for p in places.tolist():
        by.setdefault(tuple(words[p : p + window]), []).append(p)
    covered = np.zeros(len(words) + 1, np.int64)
    for found in by.values():
        if len(found) > 1:
            np.add.at(covered, found, 1)
            np.add.at(covered, np.array(found) + window, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


_RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, content_words long, n_lines long, content_lines long, kept boolean"
)


def judge(
    docs: DataFrame,
    field: Field,
    min_share: float = MIN_SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document with its counts, ``content_words`` and the verdict ``kept``.

    Words are runs without ASCII white space. A null or empty text has no words and fails the base
    counts (fewer than 20 words); so does a text whose words mostly (over 30 %) lie in windows of
    eight words that occur again. Null ids and repeated rows are kept, an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(10)]
            for text in batch.column("text").to_pylist():
                raw = text.encode()
                words = raw.split()
                features, sizes, repeated = _sequence(raw)
                again = repeat_words(words)
                failed = len(words) < 20 or 100 * again > 30 * len(words)
                label = field.decode(features) if sizes else np.zeros(0, np.int8)
                content = int(np.dot(label, sizes)) if sizes else 0
                values = (
                    len(words),
                    len(text) - sum(map(text.count, _SPACES)),
                    len(raw) - len(raw.translate(None, _SYMBOLS)),
                    repeated,
                    again,
                    failed,
                    content,
                    len(sizes),
                    int(label.sum()),
                    not failed and content >= min_share * len(words),
                )
                for col, v in zip(cols, values):
                    col.append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.int64()] * 3 + [pa.bool_()]
            names = [c.split()[0] for c in _RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names
            )

    return map_texts(id_and_text(docs, id_col, text_col), run, _RESULT)


def keep(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is kept; judged where they lie, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdict = []
            for text in batch.column(text_col).to_pylist():
                raw = (text or "").encode()
                words = raw.split()
                features, sizes, _ = _sequence(raw)
                ok = len(words) >= 20 and 100 * repeat_words(words) <= 30 * len(words)
                verdict.append(ok and int(np.dot(field.decode(features), sizes)) >= MIN_SHARE * len(words))
            yield batch.filter(pa.array(verdict, pa.bool_()))

    return map_texts(docs, run, docs.schema)
