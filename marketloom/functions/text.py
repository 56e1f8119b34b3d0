"""Text comparison and presence tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shop compares texts without regard to case, accents and tone marks; trailing blanks count.
COLLATION = "UNICODE_CI_AI"


def folded(col: Column | str) -> Column:
    """Column under the shop's collation, for ``=``, joins and grouping."""
    return F.collate(F.col(col) if isinstance(col, str) else col, COLLATION)


def same_text(col: Column | str, value: str) -> Column:
    return folded(col) == F.lit(value)


def blank(col: Column | str) -> Column:
    """True for NULL and the empty text; never NULL."""
    col = F.col(col) if isinstance(col, str) else col
    return col.isNull() | (col == "")


def zero(col: Column | str) -> Column:
    """True for NULL and 0; never NULL."""
    col = F.col(col) if isinstance(col, str) else col
    return col.isNull() | (col == 0)


def missing(col: Column | str) -> Column:
    """True for NULL and the empty text, in columns of any type; zero is a value."""
    col = F.col(col) if isinstance(col, str) else col
    return col.isNull() | (col.cast("string") == "")


def binary_equal(col: Column | str, value: str) -> Column:
    """Case-sensitive, NULL-safe equality."""
    col = F.col(col) if isinstance(col, str) else col
    return col.eqNullSafe(F.lit(value))
