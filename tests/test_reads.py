import datetime as dt
import json

import pytest
from conftest import by, day, frame, money, rows
from pyspark.sql import functions as F

from marketloom import schemas
from marketloom.operators import catalogue, customers, feedback, orders
from marketloom.sources.gazetteer import load_gazetteer


def keys(spark, name, *values, kind="bigint"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


# --- orders ---------------------------------------------------------------------------------


def test_orders_with_customer_drops_unknown_and_null_customers(edge):
    got = rows(orders.orders_with_customer(edge))
    assert [(r["Oid"], r["Cname"]) for r in got] == [(6, "Bob"), (5, "Bob"), (2, "Ann"), (1, "Ann")]


def test_nested_orders(edge):
    got = rows(orders.customer_orders_nested(edge, ordered=True))
    assert [r["Oid"] for r in got] == [2, 1, 6, 5, 4]  # by customer, newest first, key breaks ties
    items = {r["Oid"]: [i["Oiid"] for i in r["items"]] for r in got}
    assert items == {1: [1, 2], 2: [3], 4: [6, 7], 5: [], 6: [8]}
    first = next(r for r in got if r["Oid"] == 1)["items"][0]
    assert (first["Pname"], first["Oquantity"], first["Oprice"]) == ("fern", 2, money(5))


def test_nested_orders_of_some_customers(spark, edge):
    got = rows(orders.customer_orders_nested(edge, keys(spark, "Cid", 2, 2, 4)))
    assert [(r["Oid"], len(r["items"])) for r in got] == [(6, 1), (5, 0)]
    # keys of a narrower integer type find the same rows
    got = rows(orders.customer_orders_nested(edge, keys(spark, "Cid", 2, kind="int")))
    assert [r["Oid"] for r in got] == [6, 5]


def test_seed_orders_newest_first(spark, seed):
    t = {**seed, "order_items": frame(spark, "order_items", [])}
    got = [r["Oid"] for r in rows(orders.customer_orders_nested(t, keys(spark, "Cid", 5)))]
    assert got == [14, 13, 12, 11, 10, 9, 8, 7, 6]


def test_a_hot_order_keeps_its_items_in_order(spark):
    """A third of all items belongs to one order."""
    items = [
        {"Oiid": i, "Oid": 1 if i % 3 == 0 else i, "Pid": i % 5, "Oquantity": 1, "Oprice": money(i)}
        for i in range(1, 3000)
    ]
    t = {
        "orders": frame(spark, "orders", [{"Oid": i, "Cid": 1} for i in range(1, 3000)]),
        "order_items": frame(spark, "order_items", items[::-1]),
        "products": frame(spark, "products", [{"Pid": i, "Pname": f"p{i}"} for i in range(5)]),
    }
    want = {i: [] for i in range(1, 3000)}
    for x in items:
        want[x["Oid"]].append(x["Oiid"])
    got = rows(orders.customer_orders_nested(t))
    assert len(got) == 2999
    assert {r["Oid"]: [i["Oiid"] for i in r["items"]] for r in got} == want
    names = by(orders.customer_order_summary(t), "Oid")
    assert names[1]["products"] == ", ".join(f"p{i % 5}" for i in want[1])
    flat = [(r["Oid"], r["Oiid"]) for r in rows(orders.order_items_flat(t, ordered=True))]
    assert flat == [(o, i) for o in sorted(want, reverse=True) for i in want[o]]


def test_order_detail_keeps_items_without_order_or_customer(spark, edge):
    got = by(orders.order_detail(edge, keys(spark, "Oid", 1, 1, 4, 88, 1234)), "Oid")
    assert len(got) == 4
    assert got[1]["Cname"] == "Ann" and len(got[1]["items"]) == 2
    assert got[4]["Ostatus"] is None and got[4]["Cname"] is None and len(got[4]["items"]) == 2
    assert got[88]["Oprice"] is None and got[88]["items"][0]["Oquantity"] == 4
    assert got[1234]["items"] == []


def test_summary(spark, edge):
    got = by(orders.customer_order_summary(edge), "Oid")
    assert {k: r["products"] for k, r in got.items()} == {
        1: "fern, moss",
        2: "fern",  # the item of an unknown product adds nothing
        4: "fern, fern",
        5: None,  # no items
        6: None,  # only a product without a name
    }
    some = rows(orders.customer_order_summary(edge, keys(spark, "Cid", 1)))
    assert [r["Oid"] for r in some] == [2, 1]


def test_strict_summary(edge):
    got = rows(orders.customer_order_summary_strict(edge, ordered=True))
    assert [r["Oid"] for r in got] == [4, 6, 2, 1]
    assert got[1]["products"] is None  # its product has no name, but exists
    assert got[3]["Ototal"] == money(10)


def test_sales_of_the_seed(seed):
    got = rows(orders.sales_stats(seed, "2025-06-20"))[0]
    assert got == {
        "totalOrders": 14,
        "totalSales": money(6240),
        "cancelledOrders": 8,
        "failedOrders": 0,
        "salesToday": money(1780),
        "salesThisWeek": money(6240),
        "salesThisMonth": money(6240),
    }
    later = rows(orders.sales_stats(seed, day("2025-06-23")))[0]
    assert (later["salesToday"], later["salesThisWeek"]) == (money(0), money(0))
    assert later["salesThisMonth"] == money(6240)


def test_sales_without_orders(spark):
    got = rows(orders.sales_stats({"orders": frame(spark, "orders", [])}, "2025-06-20"))[0]
    assert got.pop("totalOrders") == 0
    assert set(got.values()) == {None}


@pytest.mark.parametrize(
    "as_of, week, month",
    [
        ("2024-12-31", "80.00", "10.00"),  # 2024-12-30 .. 2025-01-05 is one ISO week
        ("2021-01-01", "30.00", "30.00"),  # 2021-01-03 is the Sunday of 2020's last week
        ("2025-01-06", "40.00", "110.00"),
    ],
)
def test_iso_week_at_new_year(edge, as_of, week, month):
    got = rows(orders.sales_stats(edge, as_of))[0]
    assert (got["salesThisWeek"], got["salesThisMonth"]) == (money(week), money(month))


def test_sales_ignores_case_of_status(spark):
    states = ("Cancelled", "CANCELLED", "cancelled ", None)
    table = [{"Oid": i, "Ostatus": s} for i, s in enumerate(states)]
    t = {"orders": frame(spark, "orders", table)}
    assert rows(orders.sales_stats(t, "2025-01-01"))[0]["cancelledOrders"] == 2


# --- customers ------------------------------------------------------------------------------


def test_order_counts(seed, edge):
    got = by(customers.customers_with_order_count(seed), "Cid")
    assert len(got) == 12
    assert {k: r["orderCount"] for k, r in got.items() if r["orderCount"]} == {1: 4, 5: 9, 12: 1}
    assert "Cpassword" not in got[1]
    # 'Deleted' equals 'deleted', NULL compares as unknown
    assert set(by(customers.customers_with_order_count(edge), "Cid")) == {1, 4}


def test_profile_contract(spark, seed):
    """An existing id gives its row, an unknown one nothing."""
    got = by(customers.customer_profiles(seed, keys(spark, "Cid", 1, 9999)), "key")
    assert got[1]["found"] and got[1]["Cid"] == 1
    assert not got[9999]["found"] and got[9999]["Cid"] is None
    assert "Cpassword" not in got[1]
    assert customers.customer_profiles(seed).count() == 12


def test_profile_by_user_name_ignores_case_and_accents(spark, edge):
    asked = keys(spark, "Cusername", "JOSÉ", "Ann", "nobody", "ann ", kind="string")
    got = by(customers.customer_profiles(edge, asked, by="Cusername"), "key")
    assert {k: r["Cid"] for k, r in got.items()} == {"JOSÉ": 3, "Ann": 1, "nobody": None, "ann ": None}


def test_lowest_key_wins_among_equal_user_names(spark):
    table = [{"Cid": 9, "Cusername": "A"}, {"Cid": 4, "Cusername": "á"}]
    t = {"customers": frame(spark, "customers", table)}
    got = rows(customers.customer_profiles(t, keys(spark, "Cusername", "a", kind="string"), "Cusername"))
    assert [r["Cid"] for r in got] == [4]


# --- catalogue ------------------------------------------------------------------------------


def test_catalogue(spark, edge):
    got = by(catalogue.product_catalogue(edge), "Pid")
    assert (got[1]["typenproduct"], got[1]["subname"]) == ("indoor", "shade")
    assert (got[2]["typenproduct"], got[2]["subname"]) == (None, None)
    assert len(got) == 3
    assert set(by(catalogue.products_by_type(edge, keys(spark, "Typeid", 2, 3)), "Pid")) == {2}
    assert rows(catalogue.subtypes_of(edge, keys(spark, "Typeid", 1))) == [
        {"Subtypeid": 1, "subname": "shade"}
    ]
    assert catalogue.product_types(edge).count() == 1


def test_latest_products(seed):
    assert [r["Pid"] for r in rows(catalogue.latest_products(seed))] == list(range(10, 0, -1))
    assert [r["Pid"] for r in rows(catalogue.latest_products(seed, 3))] == [10, 9, 8]


def test_product_lookup(spark, seed):
    asked = keys(spark, "key", "1", " 2 ", "12abc", "99", "1e1", "2.5", "", "1", kind="string")
    got = by(catalogue.product_lookup(seed, asked), "key")
    assert {k: (r["valid"], r["found"], r["Pid"]) for k, r in got.items()} == {
        "1": (True, True, 1),
        " 2 ": (True, True, 2),
        "12abc": (False, False, None),
        "99": (True, False, 99),
        "1e1": (True, True, 10),
        "2.5": (True, False, None),
        "": (False, False, None),
    }


def test_favorites(spark, edge):
    got = rows(catalogue.favorite_products(edge))
    assert sorted((r["customer_id"], r["Pid"]) for r in got) == [(1, 1), (1, 1), (1, 2)]
    assert rows(catalogue.favorite_products(edge, keys(spark, "customer_id", 2))) == []


def test_addresses_from_the_json_file(spark, edge, tmp_path):
    def entry(name, district, province, code):
        return {
            "name_th": name,
            "amphure": {"name_th": district, "province": {"name_th": province}},
            "zip_code": code,
        }

    path = tmp_path / "places.json"
    entries = [
        entry("ตำบลสอง", "d1", "p1", 10100),
        entry("first of 10200", "d2", "p2", "10200"),
        entry("second of 10100", "d3", "p3", 10100),
    ]
    path.write_text(json.dumps(entries, ensure_ascii=False), encoding="utf-8")
    places = load_gazetteer(spark, str(path))
    assert [r["subdistrict"] for r in rows(places.orderBy("pos"))] == [e["name_th"] for e in entries]
    got = by(catalogue.enrich_addresses(edge["customers"], places, "Czipcode"), "Cid")
    assert {k: (r["zip_found"], r["subdistrict"], r["province"]) for k, r in got.items()} == {
        1: (True, "ตำบลสอง", "p1"),
        2: (True, "first of 10200", "p2"),
        3: (False, None, None),
        4: (False, None, None),
    }


# --- feedback -------------------------------------------------------------------------------


def test_recent_reviews_break_ties_by_key(spark):
    at = [1, 1, 1, 1, 1, 2, 3]
    reviews = [
        {"id": i + 1, "text": "x", "stars": 5, "created_at": dt.datetime(2025, 6, at[i])}
        for i in range(7)
    ]
    got = rows(feedback.recent_reviews({"reviews": frame(spark, "reviews", reviews)}))
    assert [r["id"] for r in got] == [7, 6, 5, 4, 3, 2, 1]
    assert set(got[0]) == {"id", "text", "stars"}


def test_reviews_and_orders(spark, edge):
    assert [r["id"] for r in rows(feedback.reviews_with_order(edge))] == [2, 1]
    got = by(feedback.review_of_order(edge, keys(spark, "order_id", 1, 2, 500)), "order_id")
    assert {k: (r["found"], r["id"]) for k, r in got.items()} == {
        1: (True, 1),
        2: (False, None),
        500: (True, 4),
    }


def test_payments(spark, edge):
    got = rows(feedback.payments_with_account(edge))
    assert [(r["Payid"], r["Tname"]) for r in got] == [(2, "bank b"), (1, "bank a")]
    first = by(feedback.payment_of_order(edge, keys(spark, "Oid", 1, 2, 3)), "Oid")
    assert {k: (r["found"], r["Payid"]) for k, r in first.items()} == {
        1: (True, 1),
        2: (False, None),
        3: (False, None),
    }
    assert feedback.transfer_accounts(edge).count() == 2


def test_reads_of_empty_tables(spark):
    t = {name: frame(spark, name, []) for name in schemas.table_names()}
    for query in (
        orders.orders_with_customer,
        orders.customer_orders_nested,
        orders.customer_order_summary,
        orders.customer_order_summary_strict,
        customers.customers_with_order_count,
        catalogue.product_catalogue,
        catalogue.latest_products,
        catalogue.favorite_products,
        feedback.recent_reviews,
        feedback.reviews_with_order,
        feedback.payments_with_account,
    ):
        assert query(t).agg(F.count("*")).first()[0] == 0
