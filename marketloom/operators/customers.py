"""Customers and their profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.keyed import join_grouped
from marketloom.functions.text import folded

Tables = dict[str, DataFrame]

PROFILE = [
    "Cid", "Cusername", "Cstatus", "Cname", "Caddress", "Csubdistrict", "Cdistrict", "Cprovince",
    "Czipcode", "Cphone", "Cdate", "Cbirth", "Cprofile",
]


def customers_with_order_count(t: Tables) -> DataFrame:
    """Customers that are not deleted, with the number of their orders; without the password.

    A NULL status compares as unknown and drops the row as well.
    """
    counts = t["orders"].groupBy("Cid").agg(F.count("*").alias("orderCount"))
    return (
        t["customers"]
        .drop("Cpassword")
        .where(folded("Cstatus") != F.lit("deleted"))
        .join(counts, "Cid", "left")
        .withColumn("orderCount", F.coalesce("orderCount", F.lit(0).cast("long")))
    )


def _classes(texts: DataFrame) -> DataFrame:
    """The class of every distinct text in ``key``: the least of the texts equal to it.

    Comparing under the collation is slow; that is done here only, once per distinct text.
    """
    distinct = texts.select("key").distinct().withColumn("_folded", folded("key"))
    least = distinct.groupBy("_folded").agg(F.min("key").alias("class"))
    return distinct.join(least, "_folded").select("key", "class")


def customer_profiles(
    t: Tables, keys: DataFrame | None = None, by: str = "Cid"
) -> DataFrame:
    """Profile columns of all customers, or one row per key with a ``found`` flag.

    ``by`` is ``Cid`` or ``Cusername``. User names are compared under the shop's collation; if
    several customers match, the lowest key is taken.
    """
    profiles = t["customers"].select(*PROFILE)
    if keys is None:
        return profiles
    asked = keys.select(F.col(by).alias("key")).distinct()
    if by == "Cid":
        hits = profiles.select(F.col("Cid").alias("key"), F.struct(*PROFILE).alias("hit"))
    else:
        names = profiles.select(F.col("Cusername").alias("key")).where("key IS NOT NULL")
        classes = _classes(names.unionByName(asked.where("key IS NOT NULL")))
        named = profiles.withColumn("key", F.col("Cusername"))
        # One customer per class, before any of the keys is joined.
        first = (
            join_grouped(named, classes, "key", "inner")
            .groupBy("class")
            .agg(F.min_by(F.struct(*PROFILE), "Cid").alias("hit"))
        )
        hits = join_grouped(join_grouped(asked, classes, "key", "inner"), first, "class", "inner").drop("class")
    return asked.join(hits, "key", "left").select(
        "key", F.col("hit").isNotNull().alias("found"), "hit.*"
    )
