"""Declared rules as checks: each returns the rows, or keys, that break the rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.functions.keyed import without_keys
from marketloom.operators.typed import fitted, unfit
from marketloom.schemas import declared

# Columns that a product update has to carry. Fixed values.
PRODUCT_TEXTS = ["Pname", "Pdetail", "Ppicture", "Pstatus"]
PRODUCT_NUMBERS = ["Pprice", "Pnumproduct", "Typeid", "Subtypeid"]


def check_unique(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number ``n``. Keys with a NULL part are free."""
    keyed = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    return (
        df.where(keyed).groupBy(*cols).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    )


def check_not_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with a NULL in a required column; ``missing`` names the columns."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]))
    return df.withColumn("missing", F.array_join(missing, ",")).where(F.col("missing") != "")


def check_foreign_key(
    child: DataFrame, parent: DataFrame, fk: str, pk: str | None = None
) -> DataFrame:
    """Child rows whose key names no parent. NULL passes."""
    keys = parent.select(F.col(pk or fk).alias(fk))
    return child.where(F.col(fk).isNotNull()).join(keys, fk, "left_anti")


def check_range(df: DataFrame, col: str, lo, hi) -> DataFrame:
    """Rows outside ``lo..hi``. NULL passes."""
    return df.where(~F.col(col).between(lo, hi))


def check_lengths(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows with a text or number too long for its declared type; ``too_long`` names the columns."""
    too_long = []
    for f in schema.fields:
        if f.name not in df.columns:
            continue
        if isinstance(f.dataType, T.VarcharType):
            bad = F.length(f.name) > f.dataType.length
        elif isinstance(f.dataType, T.DecimalType):
            bad = F.abs(F.col(f.name)) >= F.lit(10 ** (f.dataType.precision - f.dataType.scale))
        else:
            continue
        too_long.append(F.when(bad, F.lit(f.name)))
    if not too_long:
        return df.withColumn("too_long", F.lit("")).where(F.lit(False))
    names = F.array_join(F.array_compact(F.array(*too_long)), ",")
    return df.withColumn("too_long", names).where(F.col("too_long") != "")


def product_payload_faults():
    """Names of the columns of a product payload that are absent or that the table cannot hold."""
    kinds = {f.name: f.dataType for f in declared("products").fields}
    faults = [F.when(F.col(c).isNull() | unfit(c, kinds[c]), F.lit(c)) for c in PRODUCT_TEXTS]
    faults += [F.when(fitted(c, kinds[c]).isNull(), F.lit(c)) for c in PRODUCT_NUMBERS]
    return F.array_join(F.array_compact(F.array(*faults)), ",")


def check_product_payload(df: DataFrame) -> DataFrame:
    """Product payloads with a missing or wrongly typed field; ``faults`` names the fields."""
    return df.withColumn("faults", product_payload_faults()).where(F.col("faults") != "")


def cascade_delete(parent_keys: DataFrame, child: DataFrame, fk: str) -> DataFrame:
    """Child rows left after their parents in ``parent_keys`` are deleted."""
    return without_keys(child, parent_keys, fk)
