"""Numbering and running values over sorted rows, without one task per key.

Rows are range-partitioned by key and order, so a key with very many rows is cut between tasks. Each
part is reduced to one row per key, the few parts of a key are summed up in sequence, and every part
goes on from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import durable

PART, PLACE = "_part", "_place"
_ROW = (1 << 33) - 1


def cut_sorted(
    rows: DataFrame,
    by: list[str],
    order: list[str | Column],
    keep: list[str] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """The rows (columns ``keep``, all by default) as a stored table sorted by ``by`` and ``order``.

    ``_part`` is the number of the range a row fell into and ``_place`` its place in there. The
    table is written once: all that reads it sees the same ranges, after a lost executor as well.
    Rows that are equal in ``order`` follow their order in the input and may be cut apart, too.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    sort = [*by, *order, "_tie"]
    ranged = tied.repartitionByRange(*([parts] if parts else []), *sort).sortWithinPartitions(*sort)
    return durable(
        ranged.select(
            *(keep or rows.columns),
            F.spark_partition_id().alias(PART),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW)).alias(PLACE),
        )
    )


def earlier_parts(by: list[str]):
    """Window over the parts of a key before the current one."""
    return Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def on_part(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on key and part; a missing key is a key. No key has more rows here than a part holds."""
    keys = [*by, PART]
    marked = right.select(*[F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    same = [left[c].eqNullSafe(marked[f"_r_{c}"]) for c in by] + [left[PART] == marked[f"_r_{PART}"]]
    return left.join(marked, same, how).drop(*[f"_r_{c}" for c in keys])


def numbered(cut: DataFrame, by: list[str], name: str = "pos") -> DataFrame:
    """Rows of ``cut_sorted(rows, by, order)`` with their number from 1 within the key.

    Only counts per part and key are shuffled between tasks.
    """
    parts = cut.groupBy(*by, PART).agg(F.min(PLACE).alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(earlier_parts(by)), F.lit(0).cast("long"))
    starts = parts.withColumn("_before", before).drop("_n")
    return on_part(cut, starts, by).withColumn(
        name, F.col("_before") + F.col(PLACE) - F.col("_first") + 1
    ).drop("_before", "_first")
