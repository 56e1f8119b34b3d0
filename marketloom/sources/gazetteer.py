"""Postal gazetteer from a nested JSON file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.schemas import GAZETTEER_JSON


def load_gazetteer(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``zip_code, subdistrict, district, province, pos`` of a JSON file or a folder of them.

    ``multi_line`` reads one JSON array per file, otherwise one entry per line. ``pos`` orders the
    entries as they stand: by file name, by place of the split in its file, and by row, since ids
    rise while a split is read.
    """
    entries = spark.read.schema(GAZETTEER_JSON).json(path, multiLine=multi_line)
    return entries.select(
        F.col("zip_code").cast("string").alias("zip_code"),
        F.col("name_th").alias("subdistrict"),
        F.col("amphure.name_th").alias("district"),
        F.col("amphure.province.name_th").alias("province"),
        F.struct(
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("pos"),
    )
