"""The change operators over unbounded logs.

Each stream keeps one reduced row per key, built by the same grouping as the batch operator, so a
hot key is combined before the shuffle and stream and batch agree. Nothing in the shop has an event
time, so there is no watermark: state grows with the number of keys (orders, pairs, calendar
buckets). Use a RocksDB state store for large key counts. Rows may arrive in any order; ``seq``
decides, as in the batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.dates import start_of
from marketloom.operators.order_changes import resolve_orders, summarise_log
from marketloom.operators.shop_changes import (
    PAIR,
    apply_toggles,
    count_toggles,
    first_reviews,
    unreviewed,
)

GRAINS = ["day", "week", "month"]


def stream_order_status(log: DataFrame) -> DataFrame:
    """Log stream reduced per order. ``order_status`` turns its result into orders."""
    return summarise_log(log, ["Oid"])


def order_status(orders: DataFrame, reduced: DataFrame) -> DataFrame:
    return resolve_orders(orders, reduced)


def stream_favorites(log: DataFrame) -> DataFrame:
    """Toggle stream counted per pair. ``favorites_after`` turns its result into favourites."""
    return count_toggles(log)


def favorites_after(favorites: DataFrame, counts: DataFrame) -> DataFrame:
    return apply_toggles(favorites, counts)


def stream_sales(orders: DataFrame) -> DataFrame:
    """Order stream added up per calendar day, ISO week and month.

    "Today" or "this week" is then a lookup of one bucket; a running query must not filter by the
    current date, which would leave old sums behind.
    """
    buckets = F.explode(
        F.array(
            *[
                F.struct(F.lit(g).alias("grain"), start_of(g, "Odate").alias("bucket"))
                for g in GRAINS
            ]
        )
    )
    return (
        orders.select("Oprice", buckets.alias("b"))
        .groupBy("b.grain", "b.bucket")
        .agg(
            F.count("*").alias("orders"),
            F.sum("Oprice").cast("decimal(22,2)").alias("sales"),
        )
    )


def stream_first_review(new: DataFrame) -> DataFrame:
    """Review stream reduced to the first valid review per order.

    ``accepted_reviews`` drops those of orders that were reviewed before the stream began.
    """
    return first_reviews(new)


def accepted_reviews(reviews: DataFrame, first: DataFrame) -> DataFrame:
    return unreviewed(reviews, first)


KEYS = {
    "order_status": ["Oid"],
    "favorites": PAIR,
    "sales": ["grain", "bucket"],
    "first_review": ["order_id", "own"],
}
