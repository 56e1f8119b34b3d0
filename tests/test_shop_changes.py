import datetime as dt
import random
import unicodedata

import pytest
from conftest import by, day, frame, money, rows
from pyspark.sql import functions as F

from marketloom.operators import shop_changes as sc

AT = dt.datetime(2025, 2, 3, 4, 5, 6)


def reasons(df):
    return {r["seq"]: r["reason"] for r in rows(df)}


# --- reviews --------------------------------------------------------------------------------


def test_order_reviews(spark, edge):
    new = [
        (1, 2, None, 5),  # refused, so it does not block the next one
        (2, 2, "first", 4),
        (3, 2, "second", 4),
        (4, 1, "has one", 4),
        (5, 3, "stars", 6),
        (6, 700, "order need not exist", 1),
        (7, None, "no order", 1),
        (8, None, "no order", 2),
    ]
    schema = "seq bigint, order_id bigint, text string, stars int"
    state, rejects = sc.add_order_reviews(
        edge["reviews"], spark.createDataFrame(new, schema).repartition(4), AT
    )
    added = [r for r in rows(state) if r["id"] > 4]
    assert sorted((r["text"], r["order_id"]) for r in added) == sorted(
        [("first", 2), ("order need not exist", 700), ("no order", None), ("no order", None)],
    )
    assert {str(r["created_at"]) for r in added} == {"2025-02-03 04:05:06"}
    assert state.count() == 8
    assert reasons(rejects) == {
        1: "invalid",
        3: "already reviewed",
        4: "already reviewed",
        5: "invalid",
    }


def test_plain_reviews(spark, edge):
    new = [(1, "ok", 1), (2, "", 3), (3, None, 3), (4, "x", 0), (5, "x", 6), (6, "x", None), (7, "ok", 5)]
    state, rejects = sc.add_reviews(
        edge["reviews"], spark.createDataFrame(new, "seq bigint, text string, stars int"), AT
    )
    assert {r["stars"] for r in rows(state) if r["text"] == "ok"} == {1, 5}
    assert set(reasons(rejects)) == {2, 3, 4, 5, 6}


def test_delete_reviews(spark, edge):
    keys = spark.createDataFrame([(1, 3), (1, 3)], "order_id bigint, id bigint")
    left = sc.delete_reviews(edge["reviews"], keys)
    assert sorted(by(left, "id")) == [3, 4]  # the review without an order stays
    assert left.columns == edge["reviews"].columns
    assert sorted(by(sc.delete_reviews(edge["reviews"], keys, by="id"), "id")) == [1, 2, 4]


# --- products -------------------------------------------------------------------------------


def test_add_products(spark, edge):
    new = spark.createDataFrame([(1, "cactus"), (2, None)], "seq bigint, Pname string")
    got = by(sc.add_products(edge["products"], new)[0], "Pid")
    assert set(got) == {1, 2, 3, 4, 5}
    assert (got[4]["Pname"], got[4]["Prenume"], got[4]["Pprice"]) == ("cactus", 0, None)
    explicit = new.withColumn("Prenume", F.lit(None).cast("int"))
    assert by(sc.add_products(edge["products"], explicit)[0], "Pid")[4]["Prenume"] is None


def test_update_products(spark, edge):
    schema = """seq bigint, Pid bigint, Pname string, Pprice decimal(10,2), Pnumproduct int,
                Pdetail string, Ppicture string, Pstatus string, Typeid bigint, Subtypeid bigint"""
    full = (money(9), 3, "d", "", "s", 1, 1)
    changes = [
        (1, 1, "old", *full),
        (2, 1, "new", *full),
        (3, 1, None, *full),  # refused: the earlier one stands
        (4, 2, "x", None, 3, "d", "p", "s", 1, None),
        (5, 99, "unknown", *full),
    ]
    state, rejects = sc.update_products(edge["products"], spark.createDataFrame(changes, schema))
    got = by(state, "Pid")
    assert (got[1]["Pname"], got[1]["Pprice"], got[1]["Ppicture"]) == ("new", money(9), "")
    assert got[1]["Prenume"] == 4  # never replaced
    assert got[2]["Pname"] == "moss" and set(got) == {1, 2, 3}
    assert reasons(rejects) == {3: "Pname", 4: "Pprice,Subtypeid"}


def test_delete_products_cascades(spark, edge):
    keys = spark.createDataFrame([(1,), (1,), (55,)], "Pid bigint")
    products, items = sc.delete_products(edge, keys)
    assert sorted(by(products, "Pid")) == [2, 3]
    assert sorted(by(items, "Oiid")) == [2, 4, 5, 8, 9]
    assert items.columns == edge["order_items"].columns


# --- favourites -----------------------------------------------------------------------------


def test_toggles(spark, edge):
    log = [(1, 1, 1), (2, 1, 2), (3, 1, 2), (4, 5, 5), (5, 6, 6), (6, 6, 6), (7, 0, 1), (8, 1, None)]
    schema = "seq bigint, customer_id bigint, product_id bigint"
    state, rejects = sc.toggle_favorites(edge["favorites"], spark.createDataFrame(log, schema))
    got = sorted((r["customer_id"], r["product_id"]) for r in rows(state))
    # odd on a present pair removes all its copies, even leaves one
    assert got == [(1, 2), (2, 77), (5, 5)]
    assert set(reasons(rejects)) == {7, 8}


@pytest.mark.parametrize("seed", range(3))
def test_toggles_equal_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    pairs = [(c, p) for c in range(1, 9) for p in range(1, 5)]
    base = [rng.choice(pairs) for _ in range(60)]
    # one pair holds a third of the log
    log = [pairs[0] if rng.random() < 0.33 else rng.choice(pairs) for _ in range(200)]
    want = list(base)
    for pair in log:
        want = [p for p in want if p != pair] if pair in want else [*want, pair]
    table = frame(
        spark,
        "favorites",
        [{"id": i, "customer_id": c, "product_id": p} for i, (c, p) in enumerate(base, 1)],
    )
    changes = spark.createDataFrame(
        [(i, c, p) for i, (c, p) in enumerate(log, 1)],
        "seq bigint, customer_id bigint, product_id bigint",
    )
    state = rows(sc.toggle_favorites(table, changes)[0])
    assert sorted((r["customer_id"], r["product_id"]) for r in state) == sorted(want)
    assert len({r["id"] for r in state}) == len(state)


# --- accounts and customers -----------------------------------------------------------------


def test_accounts(spark, edge):
    new = [
        (1, "bank", 3, "acc", None, "a.png"),
        (2, "", 3, "acc", "br", "a.png"),
        (3, "bank", 0, "acc", "br", "a.png"),
        (4, "bank", 3, None, "br", "a.png"),
        (5, "bank", 3, "acc", "br", None),
    ]
    schema = "seq bigint, Tname string, Tnum int, Taccount string, Tbranch string, qrcode string"
    state, rejects = sc.add_transfer_accounts(edge["transfer"], spark.createDataFrame(new, schema))
    added = [r for r in rows(state) if r["Tid"] > 8]
    assert sorted((r["Tqr"], r["Tbranch"], r["Tnum"]) for r in added if r["Tbranch"]) == [("/qrs/a.png", "br", 0)]
    assert [(r["Tqr"], r["Tnum"]) for r in added if r["Tbranch"] is None] == [("/qrs/a.png", 3)]
    assert set(reasons(rejects)) == {2, 4, 5}


def test_stars_are_rounded_as_they_are_stored(spark, edge):
    new = [(1, "a", 4.6), (2, "b", 0.6), (3, "c", 5.4), (4, "d", 2.5), (5, "e", 5.5)]
    frame_ = spark.createDataFrame(new, "seq bigint, text string, stars double")
    state, rejects = sc.add_reviews(edge["reviews"], frame_)
    assert {r["text"]: r["stars"] for r in rows(state) if r["text"] in "abcde"} == {"a": 5, "d": 3}
    assert set(reasons(rejects)) == {2, 3, 5}
    of_orders = frame_.withColumn("order_id", frame_["seq"] + 10)
    state, rejects = sc.add_order_reviews(edge["reviews"], of_orders)
    got = {r["text"]: r["stars"] for r in rows(state) if r["text"] in "abcde"}
    assert got == {"a": 5, "b": 1, "c": 5, "d": 3}
    assert set(reasons(rejects)) == {5}


def test_profile_picture(spark, edge):
    changes = spark.createDataFrame(
        [(1, 1, "a"), (2, 1, "b"), (3, 2, "c"), (4, 2, None), (5, 9, "d")],
        "seq bigint, Cid bigint, file string",
    )
    got = by(sc.set_profile_picture(edge["customers"], changes), "Cid")
    assert [got[i]["Cprofile"] for i in (1, 2, 3, 4)] == ["b", None, None, None]


REQUEST = """seq bigint, Cname string, Cusername string, Caddress string, Csubdistrict string,
    Cdistrict string, Cprovince string, Czipcode string, Cpassword string, Cphone string,
    Cbirth date, Cprofile string"""


def requests(spark, *people):
    return spark.createDataFrame(
        [(s, n, u, "a", "s", "d", "p", "z", "h", "t", day("2000-01-01"), None) for s, n, u in people],
        REQUEST,
    )


def test_registration(spark, edge):
    new = requests(
        spark,
        (1, "Cid", "ANN"),  # user name taken under the collation
        (2, "jose", "free1"),  # full name taken
        (3, "Dan", "dan"),
        (4, "Dán", "other"),  # name of 3
        (5, "Eve", "other"),  # 4 was refused, so its user name is free
        (6, "Fay", "OTHER"),
        (7, "Ann", "bob"),  # both taken: the user name is named
        (8, "น้าใจ", "thai"),
        (9, "", "blank"),
        (10, "Dan ", "dan "),  # trailing blanks count
    )
    state, rejects = sc.register_customers(edge["customers"], new, "2025-02-03")
    added = [r for r in rows(state) if r["Cid"] > 4]
    assert sorted(r["Cname"] for r in added) == sorted(["Dan", "Eve", "น้าใจ", "Dan "])
    assert {(r["Cstatus"], r["Cdate"]) for r in added} == {("user", day("2025-02-03"))}
    assert reasons(rejects) == {
        1: "user name taken",
        2: "name taken",
        4: "name taken",
        6: "user name taken",
        7: "user name taken",
        9: "incomplete",
    }


def test_thai_tone_marks_do_not_tell_names_apart(spark, edge):
    bare = "".join(c for c in "น้ำใจ" if unicodedata.category(c) != "Mn" or c == "ำ")
    _, rejects = sc.register_customers(edge["customers"], requests(spark, (1, bare, "x")), "2025-02-03")
    assert reasons(rejects) == {1: "name taken"}


@pytest.mark.parametrize("seed", range(2))
def test_registration_equals_one_after_the_other(spark, seed):
    """Few names and many requests, one user name in a third of them, and a chain of conflicts."""
    rng = random.Random(seed)
    people = []
    for seq in range(1, 121):
        user = "hot" if rng.random() < 0.33 else f"u{rng.randrange(25)}"
        people.append((seq, f"n{rng.randrange(25)}", user))
    people += [(200 + i, f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(8)]
    users, names, want = {"u0"}, {"n0"}, {}
    for seq, name, user in people:
        if user in users:
            want[seq] = "user name taken"
        elif name in names:
            want[seq] = "name taken"
        else:
            users.add(user)
            names.add(name)
    base = frame(spark, "customers", [{"Cid": 1, "Cname": "N0", "Cusername": "U0"}])
    rng.shuffle(people)
    state, rejects = sc.register_customers(base, requests(spark, *people), "2025-02-03")
    assert reasons(rejects) == want
    assert state.count() == 1 + len(people) - len(want)


def serve(people):
    """(seq, user, full) one after the other."""
    users, fulls, served = set(), set(), set()
    for seq, user, full in sorted(people):
        if user not in users and full not in fulls:
            users.add(user)
            fulls.add(full)
            served.add(seq)
    return served


@pytest.mark.parametrize("fold", [1024, 5])
def test_conflicts_are_served_in_order(spark, monkeypatch, fold):
    monkeypatch.setattr(sc, "FOLD", fold)
    rng = random.Random(fold)
    people = [(seq, rng.randrange(120), rng.randrange(120)) for seq in range(1, 300)]
    rng.shuffle(people)
    got = sc._first_come(spark.createDataFrame(people, "seq bigint, user bigint, full bigint"))
    assert {r["seq"] for r in got.collect()} == serve(people)


def chain(links, rng=None):
    """Row i shares its user name with the row before and its name with the row after."""
    return [(i + 1, (i + 1) // 2, 1000 + i // 2) for i in range(links)]


def test_a_long_chain_takes_few_tables(spark, monkeypatch):
    written = []
    plain = sc.durable
    monkeypatch.setattr(sc, "durable", lambda df: written.append(1) or plain(df))
    counts = {}
    for links in (4, 48, 400):
        people = chain(links)
        written.clear()
        got = sc._first_come(spark.createDataFrame(people, "seq bigint, user bigint, full bigint"))
        assert {r["seq"] for r in got.collect()} == serve(people)
        counts[links] = len(written)
    # The tables grow with the logarithm of the chain; a table or two per link were hundreds.
    assert counts[48] <= counts[4] + 6 and counts[400] <= counts[48] + 4
