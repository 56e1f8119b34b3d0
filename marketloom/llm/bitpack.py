"""Token ids in fixed-width bit packing, with block offsets for random access.

Texts are dealt out by ranges of the document order, encoded once, and written as Parquet rows that
each hold a chunk of whole documents: the ids of the chunk at ``width`` bits each (the fewest that
hold every id of the vocabulary), cut into blocks of ``BLOCK`` ids that begin on a byte, the byte
offset of every block, and the place of every document. Any id is found by arithmetic, any range is
unpacked by numpy without touching other blocks.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marketloom.llm.common import slices

BLOCK = 4096
CHUNK_IDS = 1 << 18
# Known pieces of text in each of two generations per Python worker; only speed depends on it.
CACHE = 400_000
END_ID = 0

_GAPS = ("  ", " \n", "\n\n", "\t", "\r")
_ODD_ASCII = re.compile(r"[\x0b\x0c\x1c-\x1f]|<\|")
# A mark after a word is a piece of its own to the pattern.
_MARKS = frozenset(",.;:!?")
_PIECE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
# Characters on which regular expression libraries disagree whether they are white space, and
# the opening of special strings: such texts go to the tokenizer whole.
_ODD = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤　﻿]|<\|")


def _is_word(piece: str) -> bool:
    """One run of letters, perhaps after a space, in scripts whose letters are beyond dispute."""
    body = piece[1:] if piece[:1] == " " else piece
    return body.isalpha() and max(body) < "\u0180"


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct piece encoded once.

    The byte-level pattern never joins characters across a change from non-space to space, so a
    text is cut there, and the ids of the pieces, joined, are those of the text. The pieces of a
    text with single spaces and single line feeds are its words; other texts are cut by pattern.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer, models, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        top = max(self._tokenizer.get_vocab(with_added_tokens=True).values())
        self.width = max(1, int(top).bit_length())
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # The same model without the pattern, for pieces that the pattern would not cut.
        self._letters = Tokenizer(
            models.BPE(model["vocab"], [tuple(m) for m in model["merges"]], cache_capacity=0)
        )
        whole = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # Many words after spaces are encoded as one text that is cut before each space.
        cut = pre_tokenizers.Split(" ", "merged_with_next")
        self._letters.pre_tokenizer = pre_tokenizers.Sequence([cut, whole])
        self._bytes = np.zeros(top + 1, np.int64)  # of each token; every symbol is one byte
        for token, i in model["vocab"].items():
            self._bytes[i] = len(token)
        # Ids of pieces as they stand, and of words after a space (kept without it).
        self._bare = _Known("", self)
        self._spaced = _Known(" ", self)
        self._marks: dict[str, bytes] = {}
        self._line_feed = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def mark(self, text: str) -> bytes:
        if text not in self._marks:
            self._marks[text] = self.whole(text)
        return self._marks[text]

    def batch(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        words, others = [], []
        for p in pieces:
            (words if p[:1] == " " and _is_word(p) else others).append(p)
        if words:
            ids = np.array(self._letters.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids)
            ends = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in words])
            cuts = (4 * np.searchsorted(np.cumsum(self._bytes[ids]), ends) + 4).tolist()
            raw = ids.astype("<u4").tobytes()
            yield from zip(words, (raw[a:b] for a, b in zip([0, *cuts], cuts)))
        for p, e in zip(others, self._tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            yield p, array("I", e.ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; what is new in any of them is encoded together."""
        cut: list[bytes | list[str] | list[list[str]]] = []
        bare: set[str] = set()
        spaced: set[str] = set()
        for text in texts:
            if not text.isascii() and _ODD.search(text) or _ODD_ASCII.search(text):
                cut.append(self.whole(text))
            elif any(s in text for s in _GAPS):
                cut.append(_PIECE.findall(text))
                bare.update(cut[-1])
            else:
                lines = [line.split(" ") for line in text.split("\n")]
                cut.append(lines)
                for words in lines:
                    bare.add(words[0])
                    spaced.update(words[1:])
        self._bare.learn(bare)
        self._spaced.learn(spaced)
        heads, known = self._bare.now.__getitem__, self._spaced.now.__getitem__
        out = []
        for parts in cut:
            if isinstance(parts, bytes):
                out.append(parts)
            elif parts and isinstance(parts[0], list):
                out.append(self._line_feed.join([heads(w[0]) + b"".join(map(known, w[1:])) for w in parts]))
            else:
                out.append(b"".join(map(heads, parts)))
        return out


class _Known:
    """Ids by piece; pieces that were not seen for long make room for new ones."""

    def __init__(self, before: str, encoder: Encoder):
        self._before, self._encoder = before, encoder
        self.now: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        if len(self.now) > CACHE:
            self._older, self.now = self.now, {}
        now, older, before = self.now, self._older, self._before
        new, tails = [], []
        for p in pieces.difference(now):
            if p in older:
                now[p] = older[p]
            elif not p:
                now[p] = b"" if not before else self._encoder.mark(before)
            elif p[-1] in _MARKS and _is_word(p[:-1]):
                tails.append(p)
                if p[:-1] not in now:
                    new.append(before + p[:-1])
            else:
                new.append(before + p)
        cut = len(before)
        for p, ids in self._encoder.batch(list(dict.fromkeys(new))):
            now[p[cut:]] = ids
        for p in tails:
            now[p] = now[p[:-1]] + self._encoder.mark(p[-1])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, kept between its tasks."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack(ids: np.ndarray, width: int) -> tuple[bytes, list[int]]:
    """The ids at ``width`` bits each, lowest bit first, and the byte offset of each block."""
    if width > 32:
        raise ValueError("ids have 32 bits at most")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes(), list(range(0, len(ids) * width // 8, BLOCK * width // 8))
    parts, offsets, at = [], [], 0
    for i in range(0, len(ids), BLOCK):
        block = ids[i : i + BLOCK].astype("<u4")
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        parts.append(np.packbits(bits[:, :width].ravel(), bitorder="little").tobytes())
        offsets.append(at)
        at += len(parts[-1])
    return b"".join(parts), offsets


def unpack(payload: bytes, offsets: list[int], width: int, begin: int, end: int) -> np.ndarray:
    """Ids ``begin`` to ``end`` (without) of a chunk; reads only the blocks that hold them."""
    if end <= begin:
        return np.zeros(0, "<u4")
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", end - begin, begin * width // 8).astype("<u4")
    first, last = begin // BLOCK, (end - 1) // BLOCK
    raw = np.frombuffer(payload, np.uint8)
    stop = offsets[last + 1] if last + 1 < len(offsets) else len(raw)
    # Eight bytes from the first byte of an id hold all of it: 7 + 32 bits at most.
    raw = np.concatenate([raw[offsets[first] : stop], np.zeros(8, np.uint8)])
    i = np.arange(begin, end)
    bit = (np.asarray(offsets, np.int64)[i // BLOCK] - offsets[first]) * 8 + (i % BLOCK) * width
    byte = bit >> 3
    word = np.zeros(len(i), np.uint64)
    for k in range((width + 14) // 8):
        word |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype("<u4")


_CHUNK = (
    "shard int, chunk int, width int, shard_start long, n_ids int, payload binary,"
    " offsets array<int>, doc_ids array<long>, doc_starts array<int>"
)


def write_packed(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END_ID,
    order: list[Column] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode whole texts and write them in the order of ``order`` (default: ascending id).

    Null texts count as empty and keep their end id; rows with a null id come first; repeated ids
    stay, ordered by a hash of their text. An empty table writes a table without rows. The order holds over the
    shards: shard by shard, chunk by chunk, ``shard_start`` counts the ids of a shard before a
    chunk, ``doc_starts`` those of a chunk before a document.
    """
    texts = docs.select(
        *[c.alias(f"_o{i}") for i, c in enumerate(order or [])],
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )
    keys = [c for c in texts.columns if c.startswith("_o")] or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        width = max(own.width, int(end_id).bit_length())
        shard, chunk, before = TaskContext.get().partitionId(), 0, 0
        parts, doc_ids, starts, n = [], [], [], 0

        def row() -> pa.RecordBatch:
            payload, offsets = pack(np.frombuffer(b"".join(parts), "<u4"), width)
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "shard": shard, "chunk": chunk, "width": width, "shard_start": before,
                        "n_ids": n, "payload": payload, "offsets": offsets,
                        "doc_ids": doc_ids, "doc_starts": starts,
                    }
                ],
                schema=_ARROW,
            )

        for batch in slices(batches, 2 << 20):
            encoded = own.encode_all(batch["text"].to_pylist())
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoded):
                ids += end
                if n and n + len(ids) // 4 > CHUNK_IDS:
                    yield row()
                    chunk, before = chunk + 1, before + n
                    parts, doc_ids, starts, n = [], [], [], 0
                parts.append(ids)
                doc_ids.append(doc_id)
                starts.append(n)
                n += len(ids) // 4
        if n:
            yield row()

    # Many rows may share an id or have none; their texts divide them.
    ranges = list(dict.fromkeys([*keys, "doc_id", "_tie"]))
    tied = texts.withColumn("_tie", F.xxhash64("text"))
    dealt = tied.repartitionByRange(*ranges).sortWithinPartitions(*ranges, "text")
    dealt.select("doc_id", "text").mapInArrow(run, _CHUNK).write.parquet(path)


_ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("chunk", pa.int32()), ("width", pa.int32()),
        ("shard_start", pa.int64()), ("n_ids", pa.int32()), ("payload", pa.binary()),
        ("offsets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())),
        ("doc_starts", pa.list_(pa.int32())),
    ]
)


def shard_starts(packed: DataFrame) -> DataFrame:
    """``shard``, ``before``: ids of all shards before it. One row per written partition."""
    totals = packed.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    running = F.sum("_n").over(Window.orderBy("shard"))
    return totals.select("shard", (running - F.col("_n")).alias("before"))


def open_packed(spark: SparkSession, path: str) -> DataFrame:
    schema = T._parse_datatype_string(_CHUNK)
    return spark.read.schema(schema).parquet(path)


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The documents of written files: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens`` and ``ids`` (list; with ``digest`` instead ``ids_crc32`` over 32-bit ids)."""
    packed = open_packed(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in slices(batches):
            for row in batch.to_pylist():
                bounds = np.array([*row["doc_starts"], row["n_ids"]])
                ids = unpack(row["payload"], row["offsets"], row["width"], 0, row["n_ids"])
                cuts = list(zip(bounds.tolist(), bounds[1:].tolist()))
                if digest:
                    raw = memoryview(ids.tobytes())
                    value = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in cuts], pa.int64())
                else:
                    value = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * len(cuts), pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(bounds[:-1] + row["shard_start"], pa.int64()),
                        pa.array(np.diff(bounds), pa.int64()),
                        value,
                    ],
                    ["shard", "doc_id", "in_shard", "n_tokens", name],
                )

    name, kind = ("ids_crc32", "long") if digest else ("ids", "array<long>")
    rows = packed.mapInArrow(run, f"shard int, doc_id long, in_shard long, n_tokens long, {name} {kind}")
    return rows.join(F.broadcast(shard_starts(packed)), "shard").select(
        "doc_id", (F.col("in_shard") + F.col("before")).alias("start"), "n_tokens", name
    )


def lookup(spark: SparkSession, path: str, doc_ids: DataFrame) -> DataFrame:
    """``doc_id``, ``ids`` of the asked documents only: their chunks, and of these their blocks."""
    packed = open_packed(spark, path)
    places = packed.select(
        "shard", "chunk", "n_ids", F.posexplode(F.arrays_zip("doc_ids", "doc_starts")).alias("i", "d"), "doc_starts"
    ).select(
        "shard", "chunk", F.col("d.doc_ids").alias("doc_id"), F.col("d.doc_starts").alias("begin"),
        F.coalesce(F.try_element_at("doc_starts", F.col("i") + 2), "n_ids").alias("end"),
    )
    asked = places.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = packed.select("shard", "chunk", "width", "payload", "offsets").join(asked, ["shard", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = batch.to_pylist()
            ids = [unpack(r["payload"], r["offsets"], r["width"], r["begin"], r["end"]).tolist() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array(ids, pa.list_(pa.int64()))],
                ["doc_id", "ids"],
            )

    return rows.mapInArrow(run, "doc_id long, ids array<long>")
