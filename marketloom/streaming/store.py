"""A table of rows by key that a stream reads and changes in every micro-batch.

Rows lie in folders by a hash of their key, and the reader names the buckets that it needs. Below
the table's path:

* ``log/level=0/upto=b`` are the rows that batch ``b`` changed;
* ``log/level=i/upto=b`` are the newest rows of the last ``fan ** i`` batches, written after batch ``b``;
* ``base/before=b`` is the whole table as it was before batch ``b``.

How many batches were merged, and which folders therefore hold the table before a batch, follows
from the number of the batch alone. So a batch that is run again reads what it read before and
replaces what it wrote, and no listing or pointer has to be kept in step with the data. A table is
never spread over more than one base and ``LEVELS * (fan - 1)`` folders, whatever the age of the
stream. Folders that were merged are not deleted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Levels of folders above the base: after ``fan ** LEVELS`` batches a new base is written.
LEVELS = 2

_BUCKET, _VERSION = "_bucket", "_version"


@dataclass(frozen=True)
class KeyedStore:
    """Newest row per ``key`` of a stream's table at ``path``.

    ``buckets`` is fixed for the life of a stream: about as many as give files of 128 MB of the base.
    Every key has one row per folder, so buckets are even whatever keys the stream repeats.
    """

    spark: SparkSession
    path: str
    schema: StructType
    key: str
    buckets: int = 64
    fan: int = 8

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def start(self, table: DataFrame) -> None:
        """Write the table that the first batch finds. Rows without a key belong to nobody."""
        self._write(table.where(F.col(self.key).isNotNull()), self._base(0))

    def folders(self, before: int) -> list[tuple[int, str]]:
        """``(version, folder)`` that together hold the table before batch ``before``."""
        span = self.fan**LEVELS
        done = before - before % span
        held = [(done - 1, self._base(done))]
        for level in reversed(range(LEVELS)):
            size = self.fan**level
            while done + size <= before:
                done += size
                held.append((done - 1, self._log(level, done - 1)))
        return held

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets that ``keys`` name; at most ``buckets`` numbers reach the driver."""
        named = keys.where(F.col(self.key).isNotNull()).select(self.bucket().alias("b")).distinct()
        return [r["b"] for r in named.collect()]

    def stored(self, before: int, buckets: list[int] | None = None) -> DataFrame:
        """All stored rows that may be the newest of their key before batch ``before``."""
        return self._read(self.folders(before), buckets)

    def newest(self, stored: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c != self.key]
        return (
            stored.groupBy(self.key)
            .agg(F.max_by(F.struct(*rest), _VERSION).alias("_row"))
            .select(self.key, "_row.*")
            .select(*self.schema.names)
        )

    def put(self, batch: int, changed: DataFrame) -> None:
        """Store the rows that ``batch`` changed and merge the folders that are complete by it."""
        self._write(changed, self._log(0, batch))
        after = batch + 1
        for level in range(1, LEVELS):
            if after % self.fan**level == 0:
                size = self.fan ** (level - 1)
                parts = [batch - i * size for i in reversed(range(self.fan))]
                merged = self._read([(v, self._log(level - 1, v)) for v in parts], None)
                self._write(self.newest(merged), self._log(level, batch))
        span = self.fan**LEVELS
        if after % span == 0:
            size = self.fan ** (LEVELS - 1)
            parts = [batch - i * size for i in reversed(range(self.fan))]
            held = [(after - span - 1, self._base(after - span))]
            held += [(v, self._log(LEVELS - 1, v)) for v in parts]
            self._write(self.newest(self._read(held, None)), self._base(after))

    def _base(self, before: int) -> str:
        return f"{self.path}/base/before={before}"

    def _log(self, level: int, upto: int) -> str:
        return f"{self.path}/log/level={level}/upto={upto}"

    def _read(self, held: list[tuple[int, str]], buckets: list[int] | None) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField(_BUCKET, IntegerType())])
        rows = None
        for version, folder in held:
            part = self.spark.read.schema(schema).parquet(folder)
            if buckets is not None:
                part = part.where(F.col(_BUCKET).isin(buckets))
            part = part.drop(_BUCKET).withColumn(_VERSION, F.lit(version))
            rows = part if rows is None else rows.unionByName(part)
        return rows

    def _write(self, rows: DataFrame, folder: str) -> None:
        # One task per bucket, so that a bucket is one file per folder.
        placed = rows.select(*self.schema.names, self.bucket().alias(_BUCKET))
        placed.repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(folder)
