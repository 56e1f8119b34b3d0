"""Packed token files: exact round trips against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import bitpack as B
from marketloom.session import scratch_path
from llm_rows import clashing, docs, vocabulary  # noqa: F401

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    "Plain words, and more words.", "", None, "  two  spaces \n\n new\tline  ", "don't we'll it's 12 345",
    "<|endoftext|> inside <|endoftext|>", "é ü ñ 漢字   nbsp   em \x1c sep", "x" * 5000,
    "word " * 60_000, " ", "\n", "á combining", "end space ", "​zero", "a 　 b", "\r\n crlf\r\n",
]


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 24, 31, 32])
def test_pack_and_unpack_any_range(width):
    rnd = np.random.default_rng(width)
    ids = rnd.integers(0, 2**width, 3 * B.BLOCK + 77, dtype=np.uint64).astype("<u4")
    payload, offsets = B.pack(ids, width)
    assert len(payload) <= len(ids) * width / 8 + len(offsets)
    for begin, end in [(0, len(ids)), (0, 0), (5, 6), (B.BLOCK - 1, 2 * B.BLOCK + 1), (3 * B.BLOCK, len(ids))]:
        assert (B.unpack(payload, offsets, width, begin, end) == ids[begin:end]).all()


def whole(path, text):
    t = tokenizers.Tokenizer.from_file(path)
    return t.encode(text or "", add_special_tokens=False).ids


def test_files_hold_the_ids_of_the_library_in_order(spark, vocabulary):
    name = vocabulary("byte_bpe_50k.json")
    rows = [(3 * i - 4, t) for i, t in enumerate(TEXTS)]
    shuffled = random.Random(2).sample(rows, len(rows))
    df = clashing(docs(spark, shuffled).repartition(5), ["shard", "chunk", "width", "start", "_o0"])
    path = scratch_path(spark, "t")
    B.write_packed(df, path, name)
    got = {r.doc_id: r for r in B.read_ids(spark, path).collect()}
    crc = {r.doc_id: r for r in B.read_ids(spark, path, digest=True).collect()}
    start = 0
    for i, text in rows:
        want = [*whole(name, text), 0]
        assert (got[i].ids, got[i].n_tokens, got[i].start) == (want, len(want), start), text
        assert crc[i].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    asked = spark.createDataFrame([(2,), (20,), (20,), (999,)], "doc_id long")
    assert {r.doc_id: r.ids for r in B.lookup(spark, path, asked).collect()} == {i: got[i].ids for i in (2, 20)}
    assert {r.width for r in spark.read.parquet(path).collect()} == {16}


def test_nulls_repeats_given_order_and_no_rows(spark, vocabulary):
    name = vocabulary("byte_bpe_50k.json")
    df = docs(spark, [(5, "b"), (None, "n"), (5, "a"), (1, None)])
    path = scratch_path(spark, "t")
    B.write_packed(df, path, name)
    rows = sorted(map(tuple, B.read_ids(spark, path).select("start", "doc_id", "n_tokens").collect()))
    assert rows == [(0, None, 2), (2, 1, 1), (3, 5, 2), (5, 5, 2)]
    path = scratch_path(spark, "t")
    B.write_packed(df, path, name, order=[-F.col("doc_id")])
    assert [r.doc_id for r in B.read_ids(spark, path).orderBy("start").collect()] == [None, 5, 5, 1]
    path = scratch_path(spark, "t")
    B.write_packed(df.where("doc_id > 99"), path, name)
    assert B.read_ids(spark, path).count() == 0


def test_pieces_join_to_the_whole_text(vocabulary):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    own = B.encoder(vocabulary("byte_bpe_50k.json"))
    alphabet = st.sampled_from(list("ab é'sS,.1<|>\n\t\r  漢  "))

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet, max_size=40))
    def check(text):
        assert own.encode(text) == own.whole(text)

    check()


def test_rows_without_an_id_are_divided(spark, vocabulary):
    """All rows lack an id: they are written by several tasks and numbered without gaps."""
    df = docs(spark, [(None, f"word {i}") for i in range(2000)])
    path = scratch_path(spark, "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        B.write_packed(df, path, vocabulary("byte_bpe_50k.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert B.open_packed(spark, path).select("shard").distinct().count() > 2
    at = 0
    for r in B.read_ids(spark, path).orderBy("start").collect():
        assert r.start == at
        at += r.n_tokens
    assert at > 2000


def test_the_driver_loads_no_tokenizer(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(B, "_ENCODERS", {})
    path = scratch_path(spark, "t")
    B.write_packed(docs(spark, [(1, "a b"), (2, "c")]), path, vocabulary("byte_bpe_50k.json"))
    assert B.read_ids(spark, path).count() == 2 and not B._ENCODERS
