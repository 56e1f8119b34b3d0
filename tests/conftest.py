from __future__ import annotations

import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from marketloom import schemas  # noqa: E402
from marketloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "marketloom-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def money(value) -> Decimal:
    return Decimal(value).quantize(Decimal("0.01"))


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def frame(spark, table: str, rows: list[dict]):
    """Typed frame of a shop table; columns not given are NULL."""
    schema = schemas.schema(table)
    for f in schema.fields:
        f.nullable = True
    return spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], schema)


def rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def by(df, key: str) -> dict:
    return {r[key]: r for r in rows(df)}


SEED_PRICES = [450] * 5 + [750, 320, 380, 240, 520, 570, 330, 450, 430]


@pytest.fixture(scope="session")
def seed(spark):
    """Fourteen orders in the shape of the shop's seed data, with invented names."""
    owner = [1] * 4 + [12] + [5] * 9
    status = ["pending"] * 5 + ["cancelled"] * 8 + ["waiting"]
    orders = [
        {
            "Oid": i + 1,
            "Oprice": money(SEED_PRICES[i]),
            "Odate": day("2025-06-19" if i < 10 else "2025-06-20"),
            "Ostatus": status[i],
            "Cid": owner[i],
        }
        for i in range(14)
    ]
    customers = [
        {
            "Cid": i,
            "Cname": f"Name {i}",
            "Cusername": f"user{i}",
            "Cpassword": "hash",
            "Cstatus": "Inactive",
        }
        for i in range(1, 13)
    ]
    products = [
        {"Pid": i, "Pname": f"Item {i}", "Pprice": money(10 * i), "Prenume": 0}
        for i in range(1, 11)
    ]
    return {
        "orders": frame(spark, "orders", orders),
        "customers": frame(spark, "customers", customers),
        "products": frame(spark, "products", products),
    }


@pytest.fixture(scope="session")
def edge(spark):
    """Tables with every awkward row: NULLs, unknown keys, ties, other cases and accents."""
    orders = [
        (1, "10.00", "2024-12-30", "shipped", 1, "cod"),
        (2, "20.00", "2025-01-05", "cancelled", 1, "transfer"),
        (3, "30.00", "2021-01-03", "failed", None, "cod"),
        (4, "40.00", "2025-01-06", "Shipped", 99, None),
        (5, "50.00", "2025-01-05", None, 2, "COD"),
        (6, None, "2025-01-05", "pending", 2, "transfer"),
    ]
    items = [
        (1, 1, 1, 2, "5.00"),
        (2, 1, 2, 1, "7.00"),
        (3, 2, 1, 1, "5.00"),
        (4, 2, 77, 1, "9.00"),
        (5, 3, 3, 1, "3.00"),
        (6, 4, 1, 1, "5.00"),
        (7, 4, 1, 1, "5.00"),
        (8, 6, 3, 1, "3.00"),
        (9, 88, 2, 4, "7.00"),
    ]
    customers = [
        (1, "Ann", "ann", "user", "10100"),
        (2, "Bob", "bob", "Deleted", "10200"),
        (3, "José", "jose", None, None),
        (4, "น้ำใจ", "nam", "Active", "99999"),
    ]
    products = [
        (1, "fern", 1, 1, "12.00"),
        (2, "moss", 2, 9, "8.00"),
        (3, None, None, None, None),
    ]
    payments = [
        (1, 1, "10.00", 7),
        (2, 1, "11.00", 8),
        (3, 2, "20.00", None),
        (4, 3, "30.00", 55),
    ]
    reviews = [
        (1, "good", 5, "2025-01-01 10:00:00", 1),
        (2, "bad", 1, "2025-01-01 10:00:00", 1),
        (3, "none", 3, "2025-01-02 10:00:00", None),
        (4, "gone", 2, None, 500),
    ]
    favorites = [(1, 1, 1), (2, 1, 1), (3, 1, 2), (4, 2, 77)]
    d = {
        "orders": [
            dict(zip(("Oid", "Oprice", "Odate", "Ostatus", "Cid", "Opayment"), o)) for o in orders
        ],
        "order_items": [
            dict(zip(("Oiid", "Oid", "Pid", "Oquantity", "Oprice"), i)) for i in items
        ],
        "customers": [
            dict(zip(("Cid", "Cname", "Cusername", "Cstatus", "Czipcode"), c), Cpassword="hash")
            for c in customers
        ],
        "products": [
            dict(zip(("Pid", "Pname", "Typeid", "Subtypeid", "Pprice"), p), Prenume=4)
            for p in products
        ],
        "product_types": [{"Typeid": 1, "typenproduct": "indoor"}],
        "subtypes": [
            {"Subtypeid": 1, "subname": "shade", "Typeid": 1},
            {"Subtypeid": 2, "subname": "sun", "Typeid": 3},
        ],
        "payments": [dict(zip(("Payid", "Oid", "Payprice", "Tid"), p)) for p in payments],
        "transfer": [
            {"Tid": 7, "Tname": "bank a", "Tnum": 1},
            {"Tid": 8, "Tname": "bank b", "Tnum": 2},
        ],
        "reviews": [
            dict(zip(("id", "text", "stars", "created_at", "order_id"), r)) for r in reviews
        ],
        "favorites": [dict(zip(("id", "customer_id", "product_id"), f)) for f in favorites],
    }
    for o in d["orders"]:
        o["Odate"] = day(o["Odate"])
    for table in d.values():
        for r in table:
            for c in ("Oprice", "Pprice", "Payprice"):
                if r.get(c) is not None:
                    r[c] = money(r[c])
            if r.get("created_at"):
                r["created_at"] = dt.datetime.fromisoformat(r["created_at"])
    return {name: frame(spark, name, table) for name, table in d.items()}
