"""Keyed building blocks that stay whole and even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HASH = "_key_hash"


def join_grouped(rows: DataFrame, grouped: DataFrame, on: list[str] | str, how: str) -> DataFrame:
    """Join ``rows``, where a key may be hot, with a side that a grouping made unique per key.

    Adaptive execution splits a hot partition only if both sides of the join come straight out of
    a shuffle. A grouped side keeps the partitioning of its grouping, is not shuffled again and so
    blocks the split. The hash of the key as a second join key makes Spark shuffle it (it is the
    small side) and lets the hot key of ``rows`` be split. If the grouped side turns out small at
    run time, Spark broadcasts it instead.
    """
    on = [on] if isinstance(on, str) else list(on)
    return _with_hash(rows, on).join(_with_hash(grouped, on), [*on, _HASH], how).drop(_HASH)


def _with_hash(df: DataFrame, on: list[str]) -> DataFrame:
    """Add the hash of the key. Equal numbers of different integer types must hash alike."""
    parts = []
    for c in on:
        kind = df.schema[c].dataType
        if isinstance(kind, T.StringType) and kind != T.StringType():
            raise TypeError(f"{c}: texts under a collation can be equal and hash differently")
        if not isinstance(kind, (T.IntegralType, T.StringType)):
            raise TypeError(f"{c}: {kind.simpleString()} is no key type")
        parts.append(F.col(c).cast("long") if isinstance(kind, T.IntegralType) else F.col(c))
    return df.withColumn(_HASH, F.xxhash64(*parts))


def only_keys(rows: DataFrame, keys: DataFrame | None, on: str) -> DataFrame:
    """Rows whose key is among ``keys`` (a set: repeats count once); all keyed rows without it."""
    if keys is None:
        return rows.where(F.col(on).isNotNull())
    return join_grouped(rows, keys.select(on).distinct(), on, "left_semi").select(*rows.columns)


def without_keys(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not among ``keys``; rows without a key stay."""
    return join_grouped(rows, keys.select(on).distinct(), on, "left_anti").select(*rows.columns)


def latest(changes: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Last value of every key by ``seq`` as a struct column ``_new``.

    The struct lets a NULL value win. Spark combines before the shuffle, so a key with very many
    changes costs one row per task.
    """
    return changes.groupBy(key).agg(F.max_by(F.struct(*values), "seq").alias("_new"))


def overwrite(
    table: DataFrame,
    last: DataFrame,
    key: str,
    values: dict[str, Column],
    guard: Column | None = None,
) -> DataFrame:
    """Replace columns of the rows that ``last`` has a ``_new`` for. Both sides hold a key once.

    ``guard`` is a condition on the row as it was, so that the table is read and shuffled once.
    """
    hit = F.col("_new").isNotNull()
    if guard is not None:
        hit &= guard
    return table.join(last, key, "left").select(
        *[
            F.when(hit, values[c]).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c)
            if c in values
            else F.col(c)
            for c in table.columns
        ]
    )


def next_key(table: DataFrame, key: str, step: Column) -> Column:
    """Generated key: the largest one present plus ``step``.

    ``step`` is unique and positive, e.g. ``seq``, so no global numbering is needed. Refused
    requests leave gaps, as they do with an auto-increment counter.
    """
    top = table.agg(F.coalesce(F.max(F.col(key).cast("long")), F.lit(0).cast("long"))).scalar()
    return top + step


def gather(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """``value`` per key.

    Lists and texts do not shrink when combined early, so the rows are shuffled first and combined
    once, and a join on the key that follows finds them in place.
    """
    return rows.repartition(key).groupBy(key).agg(value.alias(name))
