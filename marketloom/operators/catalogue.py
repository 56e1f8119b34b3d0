"""Products, types, favourites and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.keyed import join_grouped, only_keys

Tables = dict[str, DataFrame]

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def product_catalogue(t: Tables) -> DataFrame:
    """Products with the names of type and subtype, NULL where unknown."""
    types = t["product_types"].select("Typeid", "typenproduct")
    subtypes = t["subtypes"].select("Subtypeid", "subname")
    columns = [*t["products"].columns, "typenproduct", "subname"]
    return (
        t["products"].join(types, "Typeid", "left").join(subtypes, "Subtypeid", "left").select(*columns)
    )


def products_by_type(t: Tables, type_ids: DataFrame) -> DataFrame:
    """Catalogue rows of the given types; ``type_ids`` holds ``Typeid``."""
    return product_catalogue({**t, "products": only_keys(t["products"], type_ids, "Typeid")})


def latest_products(t: Tables, n: int = 10) -> DataFrame:
    """The ``n`` products with the highest keys."""
    return t["products"].orderBy(F.desc("Pid")).limit(n)


def product_lookup(t: Tables, keys: DataFrame) -> DataFrame:
    """One row per raw text ``key``: whether it is a number, whether it is found, the product.

    A number need not be written as an integer to name a product: '1e1' is 10.
    """
    text = F.trim("key")
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    whole = F.when(number == F.floor(number), number.try_cast("long"))
    asked = (
        keys.select("key")
        .distinct()
        .select(
            "key",
            number.isNotNull().alias("valid"),
            F.coalesce(text.try_cast("long"), whole).alias("Pid"),
        )
    )
    products = t["products"].withColumn("found", F.lit(True))
    return asked.join(products, "Pid", "left").select(
        "key",
        "valid",
        F.coalesce("found", F.lit(False)).alias("found"),
        *t["products"].columns,
    )


def product_types(t: Tables) -> DataFrame:
    return t["product_types"]


def subtypes_of(t: Tables, type_ids: DataFrame) -> DataFrame:
    """Key and name of the subtypes of the given types."""
    return only_keys(t["subtypes"], type_ids, "Typeid").select("Subtypeid", "subname")


def favorite_products(t: Tables, keys: DataFrame | None = None) -> DataFrame:
    """Favourite products per customer; ``keys`` holds ``customer_id``."""
    favorites = only_keys(t["favorites"], keys, "customer_id")
    return favorites.join(
        t["products"], favorites["product_id"] == t["products"]["Pid"]
    ).select("customer_id", "Pid", "Pname", "Pprice", "Ppicture")


def enrich_addresses(df: DataFrame, gazetteer: DataFrame, zip_col: str) -> DataFrame:
    """Add subdistrict, district and province of the first gazetteer entry with the row's zip code.

    Codes are compared as text. ``zip_found`` tells whether there is an entry.
    """
    place = F.struct("subdistrict", "district", "province")
    first = gazetteer.groupBy(F.col("zip_code").cast("string").alias("_zip")).agg(
        F.min_by(place, "pos").alias("_place")
    )
    return join_grouped(df.withColumn("_zip", F.col(zip_col).cast("string")), first, "_zip", "left").select(
        *df.columns, F.col("_place").isNotNull().alias("zip_found"), "_place.*"
    )
