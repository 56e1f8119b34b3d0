"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files.

Each stage reads what its predecessor kept, as a stored table with the columns of ``documents``. The
mixed order is the order of the rows in the stored table, and the token files keep it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import bitpack, crf_quality, latent_decontam, pfair, simhash_gray
from marketloom.llm.common import ship, table
from marketloom.session import durable, scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are mostly content."""
    ship(spark)
    return crf_quality.keep(docs, crf_quality.fit_on_labels(docs, table(spark, sf_dir, "labels")))


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it until no column is called so."""
    while name in docs.columns:
        name += "_"
    return name


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row with the least id, of repeats of that the first; rows without an id
    stay. Rows are told apart by a number of their own, as ids may repeat."""
    ship(spark)
    row = unused(docs, "_row")
    rows = durable(docs.withColumn(row, F.monotonically_increasing_id()))
    named = rows.where(F.col("doc_id").isNotNull())
    found = simhash_gray.near_duplicates(named, shingle=4, distance=4, id_col=row)
    placed = durable(
        found.select(F.col("doc_id").alias(row), "component").join(named.select(row, "doc_id"), row)
    )
    first = placed.groupBy("component").agg(F.min(F.struct("doc_id", row)).alias("first"))
    kept = first.select(F.col("first")[row].alias(row))
    surplus = placed.select(row).join(kept, row, "left_anti")
    return rows.join(surplus, row, "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return latent_decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the mixed order."""
    ship(spark)
    size = unused(docs, "_bytes")
    mixed = pfair.mix(docs.withColumn(size, F.octet_length("text").cast("long")), size=size)
    return mixed.orderBy("mix_slot", "mix_before").select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bit-packed ids in the order of the stored rows, read back per document."""
    ship(spark)
    path = scratch_path(spark, "packed")
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    order = [part, F.col("_metadata.row_index")]
    bitpack.write_packed(docs, path, public_tokenizers.path("byte_bpe_50k.json"), order=order)
    return bitpack.read_ids(spark, path, digest=True)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_files),
]

# The labelling, the fingerprints and the retrieval have no SQL; tests/llm/test_pipeline.py holds
# each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
