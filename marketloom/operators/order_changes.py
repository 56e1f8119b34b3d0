"""Change sets for orders and payments.

``changes`` holds one row per request with a unique, positive ``seq`` in order of arrival. An
operator returns the new state; one that can refuse also returns the refused rows with a ``reason``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.dates import as_date, as_timestamp
from marketloom.functions.keyed import join_grouped, latest, next_key, overwrite
from marketloom.functions.scan import PART, cut_sorted, earlier_parts, numbered, on_part
from marketloom.functions.text import binary_equal, blank, missing, same_text, zero
from marketloom.operators.typed import Rules, fitted, unfit
from marketloom.session import durable

Tables = dict[str, DataFrame]


def set_status(
    df: DataFrame, changes: DataFrame, key: str, col: str, allow_null: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Last status per key wins; unknown keys are ignored. ``changes``: ``seq, key, status``.

    Without ``allow_null`` a NULL or empty status is refused.
    """
    refuse = F.lit(False) if allow_null else blank("status")
    good = changes.where(~refuse).select("seq", F.col("key").alias(key), "status")
    state = overwrite(df, latest(good, key, ["status"]), key, {col: F.col("_new.status")})
    return state, changes.where(refuse).withColumn("reason", F.lit("no status"))


def _mark(df: DataFrame, keys: DataFrame, key: str, col: str, value: str) -> DataFrame:
    hits = keys.select(key).distinct().withColumn("_new", F.lit(True))
    return overwrite(df, hits, key, {col: F.lit(value)})


def soft_delete_customers(customers: DataFrame, keys: DataFrame) -> DataFrame:
    """Set the status of the customers in ``keys.Cid`` to deleted."""
    return _mark(customers, keys, "Cid", "Cstatus", "deleted")


def cancel_orders(orders: DataFrame, keys: DataFrame) -> DataFrame:
    """Cancel the orders in ``keys.Oid``, whatever their status."""
    return _mark(orders, keys, "Oid", "Ostatus", "cancelled")


def place_orders(
    t: Tables, requests: DataFrame, as_of: dt.date | str | Column | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New ``(orders, order_items, rejects)`` of nested requests.

    ``requests``: ``seq, Cid, payment, totalPrice, items[Pid, quantity, price]``. A request without
    customer, items or total is refused, and so is one whose total the table cannot hold. One bad
    item (unknown product, missing or unfit field) refuses the whole request: header and items come
    together or not at all.

    The requests are read once and their items exploded once. Items are numbered in the order of
    their requests, each part of the sorted lines going on from the lines before it.
    """
    orders_like, items_like = t["orders"], t["order_items"]
    header = Rules("orders", orders_like, {"Oprice": "totalPrice"})
    incomplete = (
        zero("Cid") | F.coalesce(F.size("items") <= 0, F.lit(True)) | F.col("totalPrice").isNull()
    )
    filed = durable(header.judge(requests, ["Oprice"], incomplete))
    complete = filed.where("reason IS NULL")
    line = Rules("order_items", items_like, {"Oquantity": "quantity", "Oprice": "price"})
    exploded = complete.select("seq", F.posexplode("items").alias("pos", "item")).select(
        "seq", "pos", "item.*"
    )
    known = t["products"].select("Pid", F.lit(True).alias("known"))
    judged = exploded.join(known, "Pid", "left").withColumn(
        "bad",
        F.col("known").isNull()
        | F.col("quantity").isNull()
        | F.col("price").isNull()
        | unfit("quantity", line.kinds["Oquantity"])
        | unfit("price", line.kinds["Oprice"]),
    )
    lines = cut_sorted(
        line.typed(judged, ["Oquantity", "Oprice"]),
        [],
        ["seq", "pos"],
        ["seq", "Pid", "quantity", "price", "bad"],
    )
    bad = lines.where("bad").select("seq").distinct()
    new_id = next_key(orders_like, "Oid", F.col("seq"))
    orders = header.typed(join_grouped(complete, bad, "seq", "left_anti"), ["Oprice"]).select(
        "seq",
        new_id.alias("Oid"),
        F.col("totalPrice").alias("Oprice"),
        as_date(as_of).alias("Odate"),
        F.when(binary_equal("payment", "cod"), F.lit("shipped")).otherwise(F.lit("pending")).alias("Ostatus"),
        "Cid",
        F.col("payment").alias("Opayment"),
        F.lit(None).cast("string").alias("Oslip"),
    )
    items = join_grouped(numbered(lines, [], "number"), bad, "seq", "left_anti").select(
        next_key(items_like, "Oiid", F.col("number")).alias("Oiid"),
        new_id.alias("Oid"),
        "Pid",
        F.col("quantity").alias("Oquantity"),
        F.col("price").alias("Oprice"),
    )
    refused = join_grouped(complete, bad, "seq", "left_semi").select(*filed.columns)
    rejects = filed.where("reason IS NOT NULL").unionByName(
        refused.withColumn("reason", F.lit("bad item"))
    )
    return orders, items, rejects


def attach_slips(orders: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attach slip urls and wait for review. ``changes``: ``seq, Oid, url``.

    Orders paid on delivery refuse a slip, unknown orders cannot take one.
    """
    cod = binary_equal("Opayment", "cod")
    state = overwrite(
        orders,
        latest(changes, "Oid", ["url"]),
        "Oid",
        {"Oslip": F.col("_new.url"), "Ostatus": F.lit("waiting")},
        guard=~cod,
    )
    guards = orders.select("Oid", cod.alias("_cod"))
    reason = F.when(F.col("_cod"), F.lit("paid on delivery")).otherwise(F.lit("unknown order"))
    rejects = (
        changes.join(guards, "Oid", "left")
        .where(F.coalesce("_cod", F.lit(True)))
        .select(*changes.columns, reason.alias("reason"))
    )
    return state, rejects


def confirm_orders(orders: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turn shipped orders into delivered ones. ``changes``: ``seq, Oid``.

    Anything but a shipped order refuses, so of several confirmations the first is taken.
    """
    first = changes.groupBy("Oid").agg(F.min("seq").alias("_first"))
    shipped = same_text("Ostatus", "shipped")
    state = overwrite(
        orders,
        first.withColumn("_new", F.lit(True)),
        "Oid",
        {"Ostatus": F.lit("delivered")},
        guard=F.coalesce(shipped, F.lit(False)),
    )
    open_ = orders.where(shipped).select("Oid")
    taken = first.join(open_, "Oid").select(F.col("_first").alias("seq"))
    rejects = changes.join(taken, "seq", "left_anti")
    return state, rejects.withColumn("reason", F.lit("not shipped"))


def record_payments(
    t: Tables, new: DataFrame, now: dt.datetime | Column | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add payments and let their orders wait: ``(payments, orders, rejects)``.

    ``new``: ``seq, Oid, Payprice, Tid, slip`` with the slip's file name. Order, price, account and
    slip are required, zeros count as given; values have to fit the table; the order has to exist.
    Orders paid on delivery take payments too.
    """
    incomplete = missing("Oid") | missing("Payprice") | missing("Tid") | F.col("slip").isNull()
    given = ["Oid", "Payprice", "Tid"]
    rules = Rules("payments", t["payments"])
    judged = rules.judge(new, given, incomplete)
    typed = rules.typed(judged.where("reason IS NULL"), given)
    complete = typed.withColumn("SlipUrl", F.concat(F.lit("/slips/"), "slip"))
    known = t["orders"].select("Oid")
    added = complete.join(known, "Oid", "left_semi").select(
        next_key(t["payments"], "Payid", F.col("seq")).alias("Payid"),
        "Oid",
        "Payprice",
        as_timestamp(now, ntz=True).alias("Paydate"),
        F.lit("waiting").alias("Paystatus"),
        "SlipUrl",
        "Tid",
    )
    payments = t["payments"].unionByName(added)
    orders = overwrite(
        t["orders"],
        latest(complete, "Oid", ["SlipUrl"]),
        "Oid",
        {"Oslip": F.col("_new.SlipUrl"), "Ostatus": F.lit("waiting")},
    )
    # The values as they came, matched by the order they fit to.
    asked = judged.where("reason IS NULL").withColumn("_order", fitted("Oid", rules.kinds["Oid"]))
    unknown = asked.join(known.withColumnRenamed("Oid", "_order"), "_order", "left_anti")
    rejects = judged.where("reason IS NOT NULL").unionByName(
        unknown.select(*new.columns, F.lit("unknown order").alias("reason"))
    )
    return payments, orders, rejects


# --- whole order logs -----------------------------------------------------------------------
#
# ``log``: ``seq, Oid, kind, status, url`` with kind set, slip, pay, cancel or confirm. A setting
# event fixes the status whatever it was; a confirmation only turns shipped into delivered. So the
# status after any stretch of the log follows from its last setting event and the last
# confirmation, and such summaries of stretches can be combined in order.
#
# A slip counts as a setting event only for orders not paid on delivery. Summaries carry both cases
# (suffix _cod and _other), so the log needs no join with the orders before it is reduced.


def _is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def _status_set() -> Column:
    """Status that the event sets, if it is a setting event."""
    return (
        F.when(_is("set"), F.col("status"))
        .when(_is("cancel"), F.lit("cancelled"))
        .otherwise(F.lit("waiting"))
    )


def summarise_log(log: DataFrame, by: list[str]) -> DataFrame:
    """Per group of ``by``: last setting event, last url and last confirmation.

    Plain maxima, so Spark combines before the shuffle, and the same grouping runs on a stream.
    """
    setting = {"cod": _is("set", "cancel", "pay"), "other": _is("set", "cancel", "pay", "slip")}
    url = {"cod": _is("pay"), "other": _is("pay", "slip")}
    parts = [F.max(F.when(_is("confirm"), F.col("seq"))).alias("confirm_seq")]
    for case in setting:
        at = F.when(setting[case], F.col("seq"))
        url_at = F.when(url[case], F.col("seq"))
        parts += [
            F.max(at).alias(f"set_seq_{case}"),
            F.max_by(F.struct(_status_set().alias("status")), at).alias(f"set_{case}"),
            F.max_by(F.struct("url"), url_at).alias(f"url_{case}"),
        ]
    return log.groupBy(*by).agg(*parts)


def _guards(orders: DataFrame) -> DataFrame:
    return orders.select(
        "Oid", binary_equal("Opayment", "cod").alias("cod"), F.col("Ostatus").alias("base")
    )


def _settled(summary: DataFrame, orders: DataFrame) -> DataFrame:
    """Summaries of known orders, with the case picked that holds for the order."""
    joined = summary.join(_guards(orders), "Oid")
    picked = [
        F.when(F.col("cod"), F.col(f"{c}_cod")).otherwise(F.col(f"{c}_other")).alias(f"{c}_")
        for c in ("set_seq", "set", "url")
    ]
    rest = [c for c in joined.columns if not c.endswith(("_cod", "_other"))]
    return joined.select(*rest, *picked)


def resolve_orders(orders: DataFrame, summary: DataFrame) -> DataFrame:
    """Orders after a log that ``summarise_log(log, ["Oid"])`` has reduced; one join with them."""
    cod = binary_equal("Opayment", "cod")
    set_seq, set_, url = (
        F.when(cod, F.col(f"_new.{c}_cod")).otherwise(F.col(f"_new.{c}_other")) for c in ("set_seq", "set", "url")
    )
    before = F.coalesce(set_, F.struct(F.col("Ostatus").alias("status")))["status"]
    confirm = F.col("_new.confirm_seq")
    confirmed = confirm.isNotNull() & (set_seq.isNull() | (confirm > set_seq))
    status = F.when(confirmed & same_text(before, "shipped"), F.lit("delivered")).otherwise(before)
    packed = summary.select("Oid", F.struct(*[c for c in summary.columns if c != "Oid"]).alias("_new"))
    return overwrite(
        orders,
        packed,
        "Oid",
        {"Ostatus": status, "Oslip": F.when(url.isNull(), F.col("Oslip")).otherwise(url["url"])},
    )


def decide_log(orders: DataFrame, log: DataFrame, parts: int | None = None) -> DataFrame:
    """Log rows with ``accepted``: whether the order took the event.

    A parallel prefix over the log sorted by order and ``seq``: it is range-partitioned, so a long
    log of one order is cut at rows, whatever its numbers are; each part is reduced to a summary per
    order, the few summaries of an order are run through in sequence, and every part then starts
    from the status it is entered with. No task sorts more than its part.
    """
    cut = cut_sorted(log, ["Oid"], ["seq"], parts=parts)
    before = earlier_parts(["Oid"])
    by = ["Oid", PART]
    entry = _settled(summarise_log(cut, by), orders).select(
        *by,
        "cod",
        F.coalesce(
            F.last("set_", ignorenulls=True).over(before), F.struct(F.col("base").alias("status"))
        ).alias("entry"),
        F.max("set_seq_").over(before).alias("entry_set"),
        F.max("confirm_seq").over(before).alias("entry_confirm"),
    )
    upto = (
        Window.partitionBy(*by)
        .orderBy("seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ahead = upto.rowsBetween(Window.unboundedPreceding, -1)
    setting = _is("set", "cancel", "pay") | (_is("slip") & ~F.col("cod"))
    status = F.coalesce(
        F.last(F.when(setting, F.struct(_status_set().alias("status"))), ignorenulls=True).over(upto),
        F.col("entry"),
    )["status"]
    set_seq = F.coalesce(F.max(F.when(setting, F.col("seq"))).over(upto), F.col("entry_set"))
    confirm_seq = F.coalesce(
        F.max(F.when(_is("confirm"), F.col("seq"))).over(ahead), F.col("entry_confirm")
    )
    open_ = confirm_seq.isNull() | F.coalesce(confirm_seq < set_seq, F.lit(False))
    accepted = (
        F.when(F.col("cod").isNull(), F.lit(False))
        .when(_is("confirm"), F.coalesce(same_text(status, "shipped"), F.lit(False)) & open_)
        .when(_is("slip"), ~F.col("cod"))
        .otherwise(F.lit(True))
    )
    return on_part(cut, entry, ["Oid"], "left").withColumn("accepted", accepted).select(*log.columns, "accepted")


def fold_order_log(
    orders: DataFrame, log: DataFrame, parts: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Apply a mixed log in sequence: ``(orders, log with accepted)``.

    Events of unknown orders change nothing and count as not accepted. ``parts`` sets the number of
    ranges that the decisions cut the log into.
    """
    return resolve_orders(orders, summarise_log(log, ["Oid"])), decide_log(orders, log, parts)
