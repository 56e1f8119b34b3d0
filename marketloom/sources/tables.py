"""Table sources and sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from marketloom import schemas


def load_tables(
    spark: SparkSession, folder: str, names: Iterable[str] | None = None
) -> dict[str, DataFrame]:
    """Parquet tables ``folder/<name>`` under their declared schema; nothing is inferred."""
    return {
        name: spark.read.schema(schemas.schema(name)).parquet(f"{folder}/{name}")
        for name in (schemas.table_names() if names is None else names)
    }


def load_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    lower: int,
    upper: int,
    partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """One table of a relational store, read in key ranges by many tasks at once.

    ``lower`` and ``upper`` only place the range borders; rows outside are read as well.
    """
    return spark.read.jdbc(
        url,
        table,
        column=schemas.PRIMARY_KEYS[table],
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=properties,
    )


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a table to a new path. An existing path is refused, so no reader loses its input."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_tables(tables: dict[str, DataFrame], folder: str) -> str:
    """Write tables that belong together below one new folder and return it.

    Change operators with several outputs (order placement, payments) commit together this way:
    hand the folder to readers only after this returns.
    """
    for name, df in tables.items():
        write_snapshot(df, f"{folder}/{name}")
    return folder


def write_json(df: DataFrame, path: str) -> None:
    """Write rows as JSON lines to a new path; nested arrays stay nested, NULL fields stay."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
