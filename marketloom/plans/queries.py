"""Every operator over the whole of the given tables, by inventory id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import catalogue, customers, feedback, orders, quality
from marketloom.operators import order_changes as oc
from marketloom.operators import shop_changes as sc
from marketloom.plans.driver_views import gazetteer, shop, stream_view, view
from marketloom.schemas import declared
from marketloom.session import durable, scratch_path
from marketloom.sources.gazetteer import load_gazetteer
from marketloom.sources.tables import load_tables, write_json, write_snapshot, write_tables
from marketloom.streaming import changes as streams
from marketloom.streaming.sinks import fold_stream, run_available

AS_OF = "2001-07-31"
ORDERED = "2024-06-01"

_ORDER_TABLES = ["orders", "order_items", "products"]
_CATALOGUE = ["products", "product_types", "subtypes"]

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _entries_text(df: DataFrame) -> DataFrame:
    """Nested items as one text, for comparison by value."""
    fields = [f"coalesce(CAST(x.{c} AS STRING), '-')" for c in ("Pid", "Oquantity", "Oprice", "Pname", "Ppicture")]
    entry = f"concat_ws(':', x.Oiid, {', '.join(fields)})"
    return df.withColumn("items", F.expr(f"array_join(transform(items, x -> {entry}), ',')"))


# --- reads ----------------------------------------------------------------------------------


@_query
def q01_orders_with_customer(spark, sf):
    return orders.orders_with_customer(shop(spark, sf, "orders", "customers"))


@_query
def q02_customer_orders_nested(spark, sf):
    return _entries_text(orders.customer_orders_nested(shop(spark, sf, *_ORDER_TABLES)))


@_query
def q02_order_items_flat(spark, sf):
    return orders.order_items_flat(shop(spark, sf, *_ORDER_TABLES))


@_query
def q03_order_detail(spark, sf):
    t = shop(spark, sf, *_ORDER_TABLES, "customers", "reviews")
    asked = t["orders"].select("Oid").unionByName(
        t["reviews"].where("order_id IS NOT NULL").select(F.col("order_id").alias("Oid"))
    )
    return _entries_text(orders.order_detail(t, asked))


@_query
def q04_customer_order_summary(spark, sf):
    return orders.customer_order_summary(shop(spark, sf, *_ORDER_TABLES))


@_query
def q05_customer_order_summary_strict(spark, sf):
    return orders.customer_order_summary_strict(shop(spark, sf, *_ORDER_TABLES))


@_query
def q06_sales_stats(spark, sf):
    return orders.sales_stats(shop(spark, sf, "orders"), as_of=AS_OF)


@_query
def q07_customers_with_order_count(spark, sf):
    return customers.customers_with_order_count(shop(spark, sf, "orders", "customers"))


@_query
def q08_product_catalogue(spark, sf):
    return catalogue.product_catalogue(shop(spark, sf, *_CATALOGUE))


@_query
def q09_products_by_type(spark, sf):
    t = shop(spark, sf, *_CATALOGUE)
    return catalogue.products_by_type(t, t["product_types"])


@_query
def q10_latest_products(spark, sf):
    return catalogue.latest_products(shop(spark, sf, "products"))


@_query
def q11_product_lookup(spark, sf):
    return catalogue.product_lookup(shop(spark, sf, "products"), view(spark, sf, "raw_keys"))


@_query
def q12_product_types(spark, sf):
    return catalogue.product_types(shop(spark, sf, "product_types"))


@_query
def q13_subtypes_of(spark, sf):
    t = shop(spark, sf, "product_types", "subtypes")
    return catalogue.subtypes_of(t, t["product_types"])


@_query
def q14_favorite_products(spark, sf):
    return catalogue.favorite_products(shop(spark, sf, "favorites", "products"))


@_query
def q15_recent_reviews(spark, sf):
    return feedback.recent_reviews(shop(spark, sf, "reviews"))


@_query
def q16_reviews_with_order(spark, sf):
    return feedback.reviews_with_order(shop(spark, sf, "reviews", "orders"))


@_query
def q17_review_of_order(spark, sf):
    t = shop(spark, sf, "reviews", "orders")
    return feedback.review_of_order(t, t["orders"].select(F.col("Oid").alias("order_id")))


@_query
def q18_payments_with_account(spark, sf):
    return feedback.payments_with_account(shop(spark, sf, "payments", "transfer"))


@_query
def q19_payment_of_order(spark, sf):
    t = shop(spark, sf, "payments", "transfer", "orders")
    return feedback.payment_of_order(t, t["orders"])


@_query
def q20_transfer_accounts(spark, sf):
    return feedback.transfer_accounts(shop(spark, sf, "transfer"))


@_query
def q21_customer_profiles(spark, sf):
    t = shop(spark, sf, "customers", "orders")
    return customers.customer_profiles(t, t["orders"].where("Cid IS NOT NULL"))


@_query
def q21_profiles_by_user_name(spark, sf):
    asked = view(spark, sf, "user_names").unionByName(view(spark, sf, "supplier_names"))
    return customers.customer_profiles(shop(spark, sf, "customers"), asked, by="Cusername")


def _places(spark, sf):
    """The gazetteer, written as JSON in its own order and read back."""
    path = scratch_path(spark, "gazetteer")
    places = gazetteer(spark, sf).repartitionByRange("pos").sortWithinPartitions("pos")
    write_json(places.drop("pos"), path)
    return load_gazetteer(spark, path, multi_line=False)


@_query
def q22_enrich_addresses(spark, sf):
    located = catalogue.enrich_addresses(
        shop(spark, sf, "customers")["customers"], _places(spark, sf), "Czipcode"
    )
    return located.select("Cid", "Czipcode", "zip_found", "subdistrict", "district", "province")


# --- sources and sinks ----------------------------------------------------------------------


@_query
def s1_load_tables(spark, sf):
    t = shop(spark, sf, "products")
    # The stored table has the declared type; the test data's totals need two more digits.
    folder = write_tables({"products": t["products"]}, scratch_path(spark, "tables"))
    return load_tables(spark, folder, ["products"])["products"]


@_query
def s2_gazetteer(spark, sf):
    return _places(spark, sf).drop("pos")


@_query
def s3_snapshot_roundtrip(spark, sf):
    path = scratch_path(spark, "snapshot")
    write_snapshot(view(spark, sf, "s_orders"), path, ["Ostatus"])
    return spark.read.parquet(path)


@_query
def s4_json_roundtrip(spark, sf):
    path = scratch_path(spark, "json")
    nested = orders.customer_orders_nested(shop(spark, sf, *_ORDER_TABLES))
    write_json(nested, path)
    return _entries_text(spark.read.schema(nested.schema).json(path))


# --- changes --------------------------------------------------------------------------------


def _log(spark, sf, *kinds):
    log = view(spark, sf, "order_log")
    return log.where(F.col("kind").isin(*kinds)) if kinds else log


def _orders(spark, sf):
    return view(spark, sf, "s_orders")


def _set_status(spark, sf, allow_null):
    changes = _log(spark, sf, "set").withColumnRenamed("Oid", "key")
    return oc.set_status(_orders(spark, sf), changes, "Oid", "Ostatus", allow_null)


@_query
def m01_set_status(spark, sf):
    return _set_status(spark, sf, True)[0]


@_query
def m01_set_status_strict(spark, sf):
    return _set_status(spark, sf, False)[0]


@_query
def m01_set_status_rejects(spark, sf):
    return _set_status(spark, sf, False)[1].select("seq", "key", "status", "reason")


@_query
def m02_soft_delete_customers(spark, sf):
    failed = _orders(spark, sf).where("Ostatus = 'failed'")
    return oc.soft_delete_customers(view(spark, sf, "s_customers"), failed)


def _place(spark, sf):
    t = shop(spark, sf, *_ORDER_TABLES)
    lists = orders.customer_orders_nested(
        {**t, "orders": t["orders"].withColumn("Cid", F.coalesce("Cid", F.lit(0).cast("long")))},
        ordered=False,
    )
    items = (
        "transform(items, x -> "
        "named_struct('Pid', x.Pid, 'quantity', "
        "CASE WHEN x.Pid % 29 = 0 THEN 3000000000 ELSE x.Oquantity END, 'price', x.Oprice))"
    )
    # Requests are an input of the operator, so they are stored before it reads them.
    requests = durable(
        lists.selectExpr(
            "Oid + 1 AS seq",
            "Cid",
            "Opayment AS payment",
            "CASE Oid % 23 WHEN 0 THEN 'much' WHEN 1 THEN '1000000000000000' "
            "ELSE CAST(Oprice AS STRING) END AS totalPrice",
            f"{items} AS items",
        )
    )
    kept = t["products"].where("Pstatus <> 'ECONOMY'")
    return oc.place_orders({**t, "products": kept}, requests, ORDERED)


@_query
def m03_place_orders(spark, sf):
    return _place(spark, sf)[0]


@_query
def m03_place_orders_items(spark, sf):
    return _place(spark, sf)[1]


@_query
def m03_place_orders_rejects(spark, sf):
    return _place(spark, sf)[2].select("seq", "reason")


def _slips(spark, sf):
    return oc.attach_slips(_orders(spark, sf), _log(spark, sf, "slip").select("seq", "Oid", "url"))


@_query
def m04_attach_slips(spark, sf):
    return _slips(spark, sf)[0]


@_query
def m04_attach_slips_rejects(spark, sf):
    return _slips(spark, sf)[1]


@_query
def m05_cancel_orders(spark, sf):
    return oc.cancel_orders(_orders(spark, sf), _log(spark, sf, "cancel"))


def _confirm(spark, sf):
    return oc.confirm_orders(_orders(spark, sf), _log(spark, sf, "confirm").select("seq", "Oid"))


@_query
def m06_confirm_orders(spark, sf):
    return _confirm(spark, sf)[0]


@_query
def m06_confirm_orders_rejects(spark, sf):
    return _confirm(spark, sf)[1]


@_query
def m07_fold_order_log(spark, sf):
    return oc.fold_order_log(_orders(spark, sf), _log(spark, sf))[0]


@_query
def m07_fold_order_log_decisions(spark, sf):
    return oc.fold_order_log(_orders(spark, sf), _log(spark, sf))[1]


def _order_reviews(spark, sf):
    return sc.add_order_reviews(
        view(spark, sf, "s_reviews"),
        view(spark, sf, "new_order_reviews"),
        F.lit(ORDERED).cast("timestamp_ntz"),
    )


def _plain_time(df):
    """Creation times without a zone, for comparison by value."""
    return df.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@_query
def m08_add_order_reviews(spark, sf):
    return _plain_time(_order_reviews(spark, sf)[0])


@_query
def m08_add_order_reviews_rejects(spark, sf):
    return _order_reviews(spark, sf)[1]


def _plain_reviews(spark, sf):
    return sc.add_reviews(
        view(spark, sf, "s_reviews"),
        view(spark, sf, "new_reviews"),
        F.lit(ORDERED).cast("timestamp_ntz"),
    )


@_query
def m09_add_reviews(spark, sf):
    return _plain_time(_plain_reviews(spark, sf)[0])


@_query
def m09_add_reviews_rejects(spark, sf):
    return _plain_reviews(spark, sf)[1]


@_query
def m10_delete_reviews_by_order(spark, sf):
    cancelled = _orders(spark, sf).where("Ostatus = 'cancelled'").selectExpr("Oid AS order_id")
    return sc.delete_reviews(view(spark, sf, "s_reviews"), cancelled)


@_query
def m10_delete_reviews_by_id(spark, sf):
    reviews = view(spark, sf, "s_reviews")
    return sc.delete_reviews(reviews, reviews.where("stars = 1"), by="id")


def _add_products(spark, sf):
    return sc.add_products(view(spark, sf, "old_products"), view(spark, sf, "new_products"))


@_query
def m11_add_products(spark, sf):
    return _add_products(spark, sf)[0]


@_query
def m11_add_products_rejects(spark, sf):
    return _add_products(spark, sf)[1]


def _update_products(spark, sf):
    return sc.update_products(view(spark, sf, "s_products"), view(spark, sf, "product_changes"))


@_query
def m12_update_products(spark, sf):
    return _update_products(spark, sf)[0]


@_query
def m12_update_products_rejects(spark, sf):
    return _update_products(spark, sf)[1].select("seq", "Pid", "reason")


def _delete_products(spark, sf):
    return sc.delete_products(shop(spark, sf, "products", "order_items"), view(spark, sf, "dropped_products"))


@_query
def m13_delete_products(spark, sf):
    return _delete_products(spark, sf)[0]


@_query
def m13_delete_products_items(spark, sf):
    return _delete_products(spark, sf)[1]


def _toggle(spark, sf):
    return sc.toggle_favorites(view(spark, sf, "s_favorites"), view(spark, sf, "favorite_log"))


@_query
def m14_toggle_favorites(spark, sf):
    return _toggle(spark, sf)[0]


@_query
def m14_toggle_favorites_rejects(spark, sf):
    return _toggle(spark, sf)[1]


def _pay(spark, sf):
    return oc.record_payments(
        shop(spark, sf, "payments", "orders"), view(spark, sf, "new_payments"), F.lit(ORDERED).cast("timestamp_ntz")
    )


@_query
def m15_record_payments(spark, sf):
    return _pay(spark, sf)[0]


@_query
def m15_record_payments_orders(spark, sf):
    return _pay(spark, sf)[1]


@_query
def m15_record_payments_rejects(spark, sf):
    return _pay(spark, sf)[2]


def _accounts(spark, sf):
    return sc.add_transfer_accounts(view(spark, sf, "s_transfer"), view(spark, sf, "new_accounts"))


@_query
def m16_add_transfer_accounts(spark, sf):
    return _accounts(spark, sf)[0]


@_query
def m16_add_transfer_accounts_rejects(spark, sf):
    return _accounts(spark, sf)[1]


def _register(spark, sf):
    return sc.register_customers(
        view(spark, sf, "s_customers"), view(spark, sf, "registrations"), ORDERED
    )


@_query
def m17_register_customers(spark, sf):
    return _register(spark, sf)[0]


@_query
def m17_register_customers_rejects(spark, sf):
    return _register(spark, sf)[1]


@_query
def m18_set_profile_picture(spark, sf):
    return sc.set_profile_picture(
        view(spark, sf, "s_customers"), view(spark, sf, "picture_changes")
    )


# --- checks ---------------------------------------------------------------------------------


@_query
def c1_duplicate_keys(spark, sf):
    return quality.check_unique(view(spark, sf, "s_order_items"), ["Oiid"])


@_query
def c2_missing_values(spark, sf):
    return quality.check_not_null(_orders(spark, sf), ["Oid", "Cid", "Odate"])


@_query
def c3_foreign_keys(spark, sf):
    t = shop(spark, sf, "reviews", "orders")
    return quality.check_foreign_key(t["reviews"], t["orders"], "order_id", "Oid")


@_query
def c4_range(spark, sf):
    return quality.check_range(view(spark, sf, "rated_items"), "stars", 1, 5)


@_query
def c5_lengths(spark, sf):
    return quality.check_lengths(view(spark, sf, "doc_products"), declared("products"))


@_query
def c6_product_payload(spark, sf):
    changes = view(spark, sf, "product_changes")
    return quality.check_product_payload(changes).select("seq", "Pid", "faults")


@_query
def c7_cascade_delete(spark, sf):
    t = shop(spark, sf, "orders", "payments")
    cancelled = t["orders"].where("Ostatus = 'cancelled'")
    return quality.cascade_delete(cancelled, t["payments"], "Oid")


# --- streams --------------------------------------------------------------------------------


def _run(spark, reduced, name):
    return run_available(reduced, scratch_path(spark, name), streams.KEYS[name])


def _parts_in_time(log, parts):
    """The rows of ``log`` in ``parts`` stretches of ``seq`` of equal width."""
    low, high = log.agg(F.min("seq"), F.max("seq")).first()
    if low is None:
        return [log]
    width = (high - low) // parts + 1
    return [log.where((F.col("seq") - low).between(i * width, (i + 1) * width - 1)) for i in range(parts)]


@_query
def x1_stream_order_status(spark, sf):
    reduced = streams.stream_order_status(stream_view(spark, sf, "order_log"))
    return streams.order_status(_orders(spark, sf), _run(spark, reduced, "order_status"))


@_query
def x1_stream_order_decisions(spark, sf):
    """The log arrives in four parts; the stream takes one at a time and is stopped in between."""
    path, folder = scratch_path(spark, "decisions"), scratch_path(spark, "arrivals")
    whole = view(spark, sf, "order_log")
    for part in _parts_in_time(whole, 4):
        part.write.mode("append").parquet(folder)
        log = spark.readStream.schema(whole.schema).parquet(folder)
        fold_stream(log, _orders(spark, sf), path, available_now=True, buckets=16).awaitTermination()
    return spark.read.parquet(f"{path}/decisions").drop("batch")


@_query
def x2_stream_favorites(spark, sf):
    counts = streams.stream_favorites(stream_view(spark, sf, "favorite_log"))
    return streams.favorites_after(view(spark, sf, "s_favorites"), _run(spark, counts, "favorites"))


@_query
def x3_stream_sales(spark, sf):
    return _run(spark, streams.stream_sales(stream_view(spark, sf, "s_orders")), "sales")


@_query
def x4_stream_first_review(spark, sf):
    first = streams.stream_first_review(stream_view(spark, sf, "new_order_reviews"))
    return streams.accepted_reviews(
        view(spark, sf, "s_reviews"), _run(spark, first, "first_review")
    )
