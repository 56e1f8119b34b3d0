"""Exact token counts of every prefix of a text, by prefix dynamic programming.

For a word of byte-pair symbols, the encoding of a prefix is the encoding of a shorter prefix plus
one token, and exactly one such token agrees with the last token before it (the two, joined, must
encode to themselves). So one pass over a word gives the last token and the count of all of its
prefixes. Words are independent of each other, so the counts of a text are the running sum of the
counts of its words. A text's answer is kept as one signed byte per character, the change of the
count; any truncation or budget question is a running sum, without encoding anything again.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import id_and_text, map_texts

# Known words in each of two generations per Python worker; only speed depends on it.
CACHE = 400_000
_CUT = re.compile("([ \t\n\r]+)")
_EASY = re.compile("[!-~¡-ÿ]*")
# A run of letters, perhaps with one mark behind: the pattern cuts before the mark only.
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([,.;:!?]?)")
_KEPT = 12  # characters of a beginning that is kept


def _symbols() -> list[str]:
    """The symbol of each byte: printable bytes stand for themselves, the others for the characters
    from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    symbol = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [symbol[b] for b in range(256)]


_SYMBOL = _symbols()


class Model:
    """The tokenizer file (byte-pair merges with word ends) and the counts of its words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab = model["vocab"]
        self.rank = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocab)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._pairs: dict[tuple[str, str], bool] = {}
        self._now: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._pieces: dict[str, list[int]] = {}
        self._steps: dict[str, tuple[int, str, int]] = {}

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _merged(self, symbols: list[str]) -> list[str]:
        """Plain byte-pair merging, used on two tokens at a time."""
        rank = self.rank
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: rank.get((symbols[i], symbols[i + 1]), 1 << 60))
            if (symbols[best], symbols[best + 1]) not in rank:
                break
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        body = token.removesuffix(self.end)
        symbols = list(body)
        if body != token:
            symbols[-1] += self.end
        return symbols

    def _agree(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            want = [left, right] if left else [right]
            left_symbols = self._symbols(left) if left else []
            known = self._pairs[key] = self._merged(left_symbols + self._symbols(right)) == want
        return known

    def _last(self, word: str, i: int, inner: list[str], end: str) -> str:
        """Last token of the encoding of ``word[:i]``, closed by ``end``."""
        vocab, pairs = self.vocab, self._pairs
        # One token only agrees, so the short ones, which are the likely ones, are tried first.
        for j in range(i - 1, max(-1, i - 1 - self.longest), -1):
            token = word[j:i] + end
            if token in vocab:
                known = pairs.get((inner[j], token))
                if known or known is None and self._agree(inner[j], token):
                    return token
        raise ValueError(f"no token ends {word[:i]!r}")

    def piece(self, word: str) -> list[int]:
        """Counts of the prefixes of one pre-token in byte symbols, each closed as a word.

        Words share beginnings, so the answers for beginnings are kept.
        """
        steps, end = self._steps, self.end
        if len(steps) > CACHE:
            steps.clear()
        inner, counts, out = [""], [0], []
        for i in range(1, len(word) + 1):
            known = steps.get(word[:i]) if i <= _KEPT else None
            if known is None:
                last = self._last(word, i, inner, end)
                closed = counts[i - len(last) + len(end)] + 1
                token = self._last(word, i, inner, "")
                known = (closed, token, counts[i - len(token)] + 1)
                if i <= _KEPT:
                    steps[word[:i]] = known
            out.append(known[0])
            inner.append(known[1])
            counts.append(known[2])
        return out

    def _known(self, piece: str) -> list[int]:
        known = self._pieces.get(piece)
        if known is None:
            known = self.piece(piece)
            if len(self._pieces) > CACHE:
                self._pieces.clear()
            self._pieces[piece] = known
        return known

    def _word(self, word: str, mark: str) -> list[int]:
        """Counts after each character of a run of letters and a mark."""
        low = word.lower()
        if low.isascii():
            counts = self._known(low)
        else:
            raw = low.encode()
            known = self._known("".join(map(_SYMBOL.__getitem__, raw)))
            # The last byte of a character is the one that no continuation byte follows.
            counts = [k for k, b in zip(known, [*raw[1:], 0]) if b & 0xC0 != 0x80]
        return [*counts, counts[-1] + 1] if mark else counts

    def _plain(self, unit: str) -> list[int] | None:
        """Counts after each character of a run without white space, from its pre-tokens; None if
        normalisation does not work character by character."""
        low = unit.lower()
        if not _EASY.fullmatch(unit):
            if not unicodedata.is_normalized("NFC", unit):
                return None
            if [c.lower() for c in unit] != list(low) or not unicodedata.is_normalized("NFC", low):
                return None
        if any(s in unit for s in self.special):
            return None
        counts, base, at = [], 0, 0
        for piece, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(low):
            if a != at:
                return None
            known = self._known(piece)
            if len(known) == b - a:
                counts += [base + k for k in known]
            else:
                place = 0
                for c in low[a:b]:
                    place += len(c.encode())
                    counts.append(base + known[place - 1])
            base, at = counts[-1], b
        if at != len(unit):
            return None
        return counts

    def _by_cluster(self, unit: str) -> list[int] | None:
        """Counts after each character of a run without white space whose normalised prefixes are
        not prefixes of the normalised run, as of letters with combining marks.

        A prefix is the normalised clusters before its last one and the normalised start of that.
        Only pre-tokens near the end can still change, so what ends four characters earlier is added
        up once, and a long pre-token is seen by its last eight characters.
        """
        if any(s in unit or s in unit.lower() for s in self.special):
            return None
        normal = self.tokenizer.normalizer.normalize_str
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        text: list[str] = []
        runs: dict[int, _Run] = {}
        fixed, first, out = 0, 0, []  # tokens of what ends before ``first``, where a pre-token starts
        for cluster in _clusters(unit):
            n = len(text)
            seen = max(first, n - 8)
            for k in range(1, len(cluster) + 1):
                part = normal(cluster[:k])
                for start, run in runs.items():
                    run.cut(max(0, n - start))
                pieces, total = [], fixed
                for _, (a, b) in split("".join(text[seen:]) + part):
                    start, end = seen + a if a else first if seen > first else seen, seen + b
                    run = runs.setdefault(start, _Run(self))
                    run.cut(end - start)
                    for x in range(start + run.length(), end):
                        run.push(text[x] if x < n else part[x - n])
                    pieces.append((start, end, run.closed()))
                    total += pieces[-1][2]
                out.append(total)
            text += part
            while pieces and pieces[0][1] <= len(text) - 4:
                fixed += pieces.pop(0)[2]
            first = pieces[0][0] if pieces else len(text)
            runs = {start: run for start, run in runs.items() if start >= first}
        return out

    def _unit(self, unit: str) -> bytes:
        if not unit or unit[0] in " \t\n\r":
            return bytes(len(unit))
        word = _WORD.fullmatch(unit)
        counts = self._word(word[1], word[2]) if word else self._plain(unit)
        if not _EASY.fullmatch(unit):
            whole = self.count(unit)
            if counts is None or counts[-1] != whole:
                counts = self._by_cluster(unit)
            if counts is not None and counts[-1] != whole:
                counts = None
        if counts is None:
            counts = [self.count(unit[:k]) for k in range(1, len(unit) + 1)]
        return array("b", [b - a for a, b in zip([0, *counts], counts)]).tobytes()

    def changes(self, text: str) -> bytes:
        """One signed byte per character: by how much the count of the prefix changes with it."""
        units = _CUT.split(text)
        try:
            return b"".join(map(self._now.__getitem__, units))
        except KeyError:
            pass
        if len(self._now) > CACHE:
            self._older, self._now = self._now, {}
        for u in units:
            if u not in self._now:
                known = self._older.get(u)
                self._now[u] = self._unit(u) if known is None else known
        return b"".join(map(self._now.__getitem__, units))


class _Run:
    """A pre-token that grows and shrinks at its end, with the last token and the count of every
    prefix."""

    def __init__(self, model: Model):
        self.model = model
        self.symbols: list[str] = []
        self.inner, self.counts, self.ends = [""], [0], [0]

    def length(self) -> int:
        return len(self.ends) - 1

    def _last(self, end: str) -> str:
        low = max(0, len(self.symbols) - self.model.longest)
        tail = "".join(self.symbols[low:])
        return self.model._last(tail, len(tail), self.inner[low:], end)

    def push(self, char: str) -> None:
        for b in char.encode():
            self.symbols.append(_SYMBOL[b])
            token = self._last("")
            self.inner.append(token)
            self.counts.append(self.counts[len(self.symbols) - len(token)] + 1)
        self.ends.append(len(self.symbols))

    def cut(self, length: int) -> None:
        if length < self.length():
            del self.ends[length + 1 :]
            del self.symbols[self.ends[-1] :], self.inner[self.ends[-1] + 1 :], self.counts[self.ends[-1] + 1 :]

    def closed(self) -> int:
        end = self.model.end
        last = self._last(end)
        return self.counts[len(self.symbols) - len(last) + len(end)] + 1


@cache
def _joining() -> frozenset[str]:
    """Characters that may compose with one before them, though they can stand alone."""
    parts = (unicodedata.decomposition(chr(c)) for c in range(sys.maxunicode + 1))
    second = {chr(int(p.split()[1], 16)) for p in parts if " " in p and p[0] != "<"}
    # The vowels and final consonants of Hangul, which compose by rule.
    return frozenset(second) | {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}


def _clusters(unit: str) -> Iterator[str]:
    """Stretches that are normalised (NFC) independently of each other."""
    start = 0
    for i in range(1, len(unit)):
        head = unicodedata.normalize("NFD", unit[i])[0]
        if not unicodedata.combining(head) and not {unit[i], head} & _joining():
            yield unit[start:i]
            start = i
    yield unit[start:]


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    """One per Python worker, kept between its tasks."""
    if path not in _MODELS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _MODELS[path] = Model(path)
    return _MODELS[path]


def prefix_counts(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` (whole text) and ``changes`` (binary).

    ``changes`` holds one signed byte per character. Null texts count as empty, null ids and
    repeated rows are kept, an empty table gives an empty result. Special strings inside a text are
    single tokens, as in the library; no tokens are added.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(tokenizer)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            changes = [own.changes(t) for t in texts]
            totals = [int(np.frombuffer(c, np.int8).sum(dtype=np.int64)) for c in changes]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(totals, pa.int64()),
                    pa.array(changes, pa.binary()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "changes"],
            )

    schema = "doc_id long, n_bytes long, n_tokens long, changes binary"
    return map_texts(id_and_text(docs, id_col, text_col), run, schema)


def answers(counts: DataFrame, lengths: list[int], budgets: list[int]) -> DataFrame:
    """Truncation and budget questions about all documents of ``prefix_counts``.

    ``at_<n>``: tokens of the first n characters (of all, if there are fewer). ``fit_<b>``: the most
    characters whose prefix has b tokens or fewer.
    """
    names = [f"at_{n}" for n in lengths] + [f"fit_{b}" for b in budgets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[int]] = [[] for _ in names]
            for raw in batch.column("changes").to_pylist():
                running = np.r_[0, np.cumsum(np.frombuffer(raw, np.int8), dtype=np.int64)]
                for col, n in zip(cols, lengths):
                    col.append(int(running[min(n, len(running) - 1)]))
                for col, b in zip(cols[len(lengths) :], budgets):
                    col.append(int(np.flatnonzero(running <= b)[-1]) if b >= 0 else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols]], ["doc_id", *names]
            )

    schema = ", ".join(["doc_id long", *[f"{n} long" for n in names]])
    return map_texts(counts.select("doc_id", "changes"), run, schema)


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    """``prefix_counts`` with ``over_limit``: the whole text has more than ``limit`` tokens."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
