"""Rows that every operator has to take, and helpers."""

import pytest


def docs(spark, rows, extra=""):
    """``rows``: (doc_id, text) pairs as a table of documents."""
    full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")


def clashing(df, names):
    """The table with extra columns of the given names."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("clash") for n in names if n not in df.columns})


@pytest.fixture(scope="session")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path
