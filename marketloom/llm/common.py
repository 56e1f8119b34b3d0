"""Shared pieces of the text operators."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; a null text counts as empty.

    All other columns are left behind here, so none of them can clash with the operator's own.
    """
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``most_bytes``, so that a task's memory does not depend on
    how long the texts of a batch are (one row is never cut)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * most_bytes / max(batch.nbytes, 1)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def map_texts(
    df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``f`` over the Arrow batches of each partition, in pieces of bounded size."""
    return df.mapInArrow(lambda batches: f(slices(batches)), schema)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, unless they import it anyway."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="marketloom-code-")
    sc.addPyFile(shutil.make_archive(f"{folder}/marketloom", "zip", root.parent, root.name))
    _SHIPPED.add(sc.applicationId)
