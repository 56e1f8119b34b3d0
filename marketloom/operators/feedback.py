"""Reviews and payments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.keyed import only_keys

Tables = dict[str, DataFrame]


def recent_reviews(t: Tables) -> DataFrame:
    """All reviews, newest first."""
    return (
        t["reviews"].orderBy(F.desc("created_at"), F.desc("id")).select("id", "text", "stars")
    )


def reviews_with_order(t: Tables) -> DataFrame:
    """Reviews of known orders, newest first."""
    orders = t["orders"].select(F.col("Oid").alias("order_id"))
    return (
        t["reviews"]
        .join(orders, "order_id")
        .select("id", "text", "stars", "created_at", "order_id")
        .orderBy(F.desc("created_at"), F.desc("id"))
    )


def _first_per(rows: DataFrame, key: str, order: str, keys: DataFrame) -> DataFrame:
    """One row per key: ``found`` and the columns of its first row by ``order``. ``rows`` holds no
    other keys."""
    rest = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("hit"))
    return keys.select(key).distinct().join(first, key, "left").select(
        key, F.col("hit").isNotNull().alias("found"), "hit.*"
    )


def review_of_order(t: Tables, keys: DataFrame) -> DataFrame:
    """First review of each order in ``keys.order_id``; NULL columns where there is none."""
    return _first_per(only_keys(t["reviews"], keys, "order_id"), "order_id", "id", keys)


def _with_account(payments: DataFrame, t: Tables) -> DataFrame:
    accounts = t["transfer"].select("Tid", "Tname", "Tnum", "Taccount", "Tbranch", "Tqr")
    return payments.join(accounts, "Tid").select(*payments.columns, *accounts.columns[1:])


def payments_with_account(t: Tables) -> DataFrame:
    """Payments with the account they went to, newest key first."""
    return _with_account(t["payments"], t).orderBy(F.desc("Payid"))


def payment_of_order(t: Tables, keys: DataFrame) -> DataFrame:
    """First payment, with its account, of each order in ``keys.Oid``."""
    asked = only_keys(t["payments"], keys, "Oid")
    return _first_per(_with_account(asked, t), "Oid", "Payid", keys)


def transfer_accounts(t: Tables) -> DataFrame:
    return t["transfer"]
