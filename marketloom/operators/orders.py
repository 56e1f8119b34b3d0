"""Queries around orders, their items and their sums.

``t`` maps table names to frames; ``keys`` is a frame of the keys asked for, or None for all.
Nested forms answer an order by one row, whatever its number of items; ``order_items_flat`` answers
it by one row per item, for orders whose items are too many for a row.

Sorted results cost a shuffle of the whole result; ``ordered=False`` leaves it out.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.dates import as_date, in_same
from marketloom.functions.keyed import gather, join_grouped, only_keys
from marketloom.functions.text import same_text

Tables = dict[str, DataFrame]

_ITEM = ["Oiid", "Pid", "Oquantity", "Oprice"]


def _sorted(df: DataFrame, ordered: bool, *by) -> DataFrame:
    return df.orderBy(*by) if ordered else df


def orders_with_customer(t: Tables, ordered: bool = True) -> DataFrame:
    """Orders of known customers with the customer's name, newest key first."""
    named = t["orders"].join(t["customers"].select("Cid", "Cname"), "Cid")
    columns = ["Oid", "Oprice", "Ostatus", "Odate", "Cname"]
    return _sorted(named.select(*columns), ordered, F.desc("Oid"))


def _items_of(t: Tables, of: DataFrame | None) -> DataFrame:
    """Items that belong to an order, of the orders in ``of`` if it is given."""
    items = t["order_items"].where(F.col("Oid").isNotNull())
    if of is None:
        return items
    return join_grouped(items, of.select("Oid").distinct(), "Oid", "left_semi")


def _item_values(
    t: Tables, how: str, columns: list[str], value: Column, name: str, of: DataFrame | None
) -> DataFrame:
    """``Oid`` and ``value`` over the order's items and their products."""
    named = _items_of(t, of).join(t["products"].select("Pid", *columns), "Pid", how)
    return gather(named, "Oid", value, name)


def _with_items(rows: DataFrame, t: Tables, of: DataFrame | None = None) -> DataFrame:
    """Rows with their ``items``: those without a product are dropped, the rest ordered by key."""
    columns = ["Pname", "Ppicture"]
    entries = F.sort_array(F.collect_list(F.struct(*_ITEM, *columns)))
    lists = _item_values(t, "inner", columns, entries, "items", of)
    empty = F.array().cast(lists.schema["items"].dataType)
    return rows.join(lists, "Oid", "left").withColumn("items", F.coalesce("items", empty))


def order_items_flat(
    t: Tables, keys: DataFrame | None = None, ordered: bool = False
) -> DataFrame:
    """One row per item of known orders and products: order columns, item, product names.

    ``keys`` holds ``Cid``. A hot order is cut freely between tasks. With ``ordered`` the rows come
    by order and, within it, in the order of the nested form.
    """
    orders = only_keys(t["orders"], keys, "Cid").withColumnRenamed("Oprice", "Ototal")
    products = t["products"].select("Pid", "Pname", "Ppicture")
    items = _items_of(t, None if keys is None else orders).select("Oid", *_ITEM).join(products, "Pid")
    flat = items.join(orders, "Oid").select(*orders.columns, *_ITEM, "Pname", "Ppicture")
    return _sorted(flat, ordered, F.desc("Oid"), *_ITEM)


def customer_orders_nested(
    t: Tables, keys: DataFrame | None = None, ordered: bool | None = None
) -> DataFrame:
    """Orders per customer with their ``items`` array. ``keys`` holds ``Cid``.

    Newest first, by default only where ``keys`` are asked for.
    """
    orders = only_keys(t["orders"], keys, "Cid")
    nested = _with_items(orders, t, of=None if keys is None else orders)
    nested = nested.select(*t["orders"].columns, "items")
    ordered = keys is not None if ordered is None else ordered
    return _sorted(nested, ordered, "Cid", F.desc("Odate"), F.desc("Oid"))


def order_detail(t: Tables, keys: DataFrame) -> DataFrame:
    """One order per key with customer name and items. ``keys`` holds ``Oid``.

    An unknown order, or one whose customer is missing, yields a row that has only its items.
    """
    keys = keys.select("Oid").distinct()
    asked = only_keys(t["orders"], keys, "Oid")
    named = asked.join(t["customers"].select("Cid", "Cname"), "Cid")
    columns = ["Oid", *[c for c in t["orders"].columns if c != "Oid"], "Cname", "items"]
    return _with_items(keys.join(named, "Oid", "left"), t, of=keys).select(*columns)


def _product_names(t: Tables, how: str, of: DataFrame | None) -> DataFrame:
    """``Oid, products``: names joined by ', '; NULL names are skipped, all NULL gives NULL."""
    names = F.expr(f"listagg(Pname, ', ') WITHIN GROUP (ORDER BY {', '.join(_ITEM)})")
    return _item_values(t, how, ["Pname"], names, "products", of)


def customer_order_summary(
    t: Tables, keys: DataFrame | None = None, ordered: bool | None = None
) -> DataFrame:
    """Orders with the names of their products as one text; orders without items stay.

    Newest key first, by default only where ``keys`` are asked for.
    """
    orders = only_keys(t["orders"], keys, "Cid")
    names = _product_names(t, "left", None if keys is None else orders)
    summary = orders.join(names, "Oid", "left").select(
        "Oid", "Odate", "Ostatus", "Oprice", "products"
    )
    return _sorted(summary, keys is not None if ordered is None else ordered, F.desc("Oid"))


def customer_order_summary_strict(
    t: Tables, keys: DataFrame | None = None, ordered: bool | None = None
) -> DataFrame:
    """As ``customer_order_summary``, but only orders that have a known product; newest first."""
    orders = only_keys(t["orders"], keys, "Cid")
    names = _product_names(t, "inner", None if keys is None else orders)
    summary = orders.join(names, "Oid").select(
        "Oid", "Odate", "Ostatus", F.col("Oprice").alias("Ototal"), "products"
    )
    ordered = keys is not None if ordered is None else ordered
    return _sorted(summary, ordered, F.desc("Odate"), F.desc("Oid"))


def sales_stats(t: Tables, as_of: dt.date | str | Column | None = None) -> DataFrame:
    """One row of counts and sums over all orders, cancelled and failed ones included.

    Without orders every sum is NULL. Statuses are compared under the shop's collation, which is
    slow per row, so the rows are first added up per distinct status.
    """
    day = as_date(as_of)
    grains = {"salesToday": "day", "salesThisWeek": "week", "salesThisMonth": "month"}

    def money(name):
        return F.sum(name).cast("decimal(22,2)").alias(name)

    def count_of(status):
        return F.sum(F.when(same_text("Ostatus", status), F.col("totalOrders")).otherwise(0))

    per_status = t["orders"].groupBy("Ostatus").agg(
        F.count("*").alias("totalOrders"),
        F.sum("Oprice").alias("totalSales"),
        *[
            F.sum(F.when(in_same(grain, "Odate", day), F.col("Oprice")).otherwise(0)).alias(name)
            for name, grain in grains.items()
        ],
    )
    return per_status.agg(
        F.coalesce(F.sum("totalOrders"), F.lit(0)).cast("long").alias("totalOrders"),
        money("totalSales"),
        count_of("cancelled").cast("long").alias("cancelledOrders"),
        count_of("failed").cast("long").alias("failedOrders"),
        *[money(name) for name in grains],
    )
