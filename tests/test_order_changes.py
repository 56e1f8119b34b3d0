import random

import pytest
from conftest import by, day, frame, money, rows
from pyspark.sql import functions as F

from marketloom.functions.scan import cut_sorted
from marketloom.operators import order_changes as oc

CHANGE = "seq bigint, Oid bigint"


def orders_frame(spark, *states):
    """Orders 1.. from (status, payment) pairs."""
    return frame(
        spark,
        "orders",
        [{"Oid": i, "Ostatus": s, "Opayment": p} for i, (s, p) in enumerate(states, 1)],
    )


def status(df):
    return {r["Oid"]: r["Ostatus"] for r in rows(df)}


def reasons(df):
    return {r["seq"]: r["reason"] for r in rows(df)}


def test_last_status_wins_even_if_null(spark):
    table = orders_frame(spark, ("a", None), ("b", None), ("c", None))
    log = [(1, 1, "x"), (2, 1, None), (3, 2, "y"), (4, 2, ""), (5, 9, "z")]
    changes = spark.createDataFrame(log, "seq bigint, key bigint, status string")
    state, rejects = oc.set_status(table, changes, "Oid", "Ostatus")
    assert status(state) == {1: None, 2: "", 3: "c"}
    assert rows(rejects) == []
    state, rejects = oc.set_status(table, changes, "Oid", "Ostatus", allow_null=False)
    assert status(state) == {1: "x", 2: "y", 3: "c"}
    assert reasons(rejects) == {2: "no status", 4: "no status"}
    assert state.columns == table.columns


def test_soft_delete_and_cancel(spark, edge):
    keys = spark.createDataFrame([(1, 1), (1, 1), (9, 9)], "Cid bigint, Oid bigint")
    got = by(oc.soft_delete_customers(edge["customers"], keys), "Cid")
    assert [got[i]["Cstatus"] for i in (1, 2, 3, 4)] == ["deleted", "Deleted", None, "Active"]
    assert status(oc.cancel_orders(edge["orders"], keys))[1] == "cancelled"
    assert len(got) == 4


def test_place_orders(spark, edge):
    schema = """seq bigint, Cid bigint, payment string, totalPrice decimal(10,2),
                items array<struct<Pid: bigint, quantity: int, price: decimal(10,2)>>"""
    ok = [(1, 2, money(5)), (1, 2, money(5))]
    requests = [
        (1, 1, "cod", money(10), ok),
        (2, 1, "COD", money(0), [(2, 1, money(1))]),
        (3, 0, "cod", money(10), ok),
        (4, None, "cod", money(10), ok),
        (5, 1, "cod", money(10), []),
        (6, 1, "cod", money(10), None),
        (7, 1, "cod", None, ok),
        (8, 1, "cod", money(10), [*ok, (4711, 1, money(1))]),  # unknown product
        (9, 1, "cod", money(10), [*ok, (2, None, money(1))]),  # quantity missing
        (10, 7, None, money(10), [(2, 1, money(1))]),
    ]
    placed, items, rejects = oc.place_orders(
        edge, spark.createDataFrame(requests, schema), "2025-02-03"
    )
    got = by(placed, "seq")
    assert {k: (r["Ostatus"], r["Oprice"]) for k, r in got.items()} == {
        1: ("shipped", money(10)),
        2: ("pending", money(0)),
        10: ("pending", money(10)),
    }
    assert {r["Odate"] for r in got.values()} == {day("2025-02-03")}
    assert all(r["Oid"] > 6 for r in got.values())
    lines = rows(items)
    assert len({r["Oiid"] for r in lines}) == 4 and min(r["Oiid"] for r in lines) > 9
    assert sorted(r["Oid"] for r in lines) == sorted([got[1]["Oid"]] * 2 + [got[2]["Oid"], got[10]["Oid"]])
    assert reasons(rejects) == {
        **dict.fromkeys((3, 4, 5, 6, 7), "incomplete"),
        8: "bad item",
        9: "bad item",
    }


def test_slips(spark):
    table = orders_frame(spark, ("pending", "transfer"), ("x", "cod"), ("x", "COD"), ("x", None))
    log = [(1, 1, "a"), (2, 1, "b"), (3, 2, "c"), (4, 3, None), (5, 4, "d"), (6, 9, "e")]
    state, rejects = oc.attach_slips(table, spark.createDataFrame(log, CHANGE + ", url string"))
    got = by(state, "Oid")
    assert {k: (r["Ostatus"], r["Oslip"]) for k, r in got.items()} == {
        1: ("waiting", "b"),
        2: ("x", None),
        3: ("waiting", None),  # only the exact text 'cod' refuses; a missing url is stored
        4: ("waiting", "d"),
    }
    assert reasons(rejects) == {3: "paid on delivery", 6: "unknown order"}


def test_confirm(spark, edge):
    log = spark.createDataFrame([(5, 1), (3, 1), (1, 2), (2, 4), (4, 99), (6, 5)], CHANGE)
    state, rejects = oc.confirm_orders(edge["orders"], log)
    got = status(state)
    assert (got[1], got[2], got[4], got[5]) == ("delivered", "cancelled", "delivered", None)
    assert set(reasons(rejects)) == {5, 1, 4, 6}


def test_confirm_of_the_seed_is_refused(spark, seed):
    log = spark.createDataFrame([(1, 1), (2, 14)], CHANGE)
    state, rejects = oc.confirm_orders(seed["orders"], log)
    assert set(reasons(rejects)) == {1, 2}
    assert status(state) == status(seed["orders"])


def test_payments(spark, edge):
    schema = CHANGE + ", Payprice decimal(10,2), Tid bigint, slip string"
    new = [
        (1, 1, money(5), 7, "a"),  # paid on delivery, taken all the same
        (2, 2, money(6), 4711, "b"),  # unknown account, which nothing forbids
        (3, 2, money(7), 7, "c"),
        (4, 999, money(7), 7, "d"),
        (5, 1, money(0), 7, "e"),
        (6, 0, money(1), 7, "f"),
        (7, 1, money(1), None, "g"),
        (8, 1, money(1), 7, None),
    ]
    at = F.lit("2025-02-03 04:05:06").cast("timestamp_ntz")
    payments, orders, rejects = oc.record_payments(edge, spark.createDataFrame(new, schema), at)
    added = [r for r in rows(payments) if r["Payid"] > 4]
    assert sorted((r["Oid"], r["SlipUrl"], r["Paystatus"]) for r in added) == [
        (1, "/slips/a", "waiting"),
        (1, "/slips/e", "waiting"),  # a price of zero counts as given
        (2, "/slips/b", "waiting"),
        (2, "/slips/c", "waiting"),
    ]
    assert {str(r["Paydate"]) for r in added} == {"2025-02-03 04:05:06"}
    got = by(orders, "Oid")
    assert (got[1]["Ostatus"], got[1]["Oslip"]) == ("waiting", "/slips/e")
    assert (got[2]["Ostatus"], got[2]["Oslip"]) == ("waiting", "/slips/c")
    assert got[3]["Ostatus"] == "failed"
    assert reasons(rejects) == {
        **dict.fromkeys((4, 6), "unknown order"),
        **dict.fromkeys((7, 8), "incomplete"),
    }


# --- the whole log --------------------------------------------------------------------------

LOG = "seq bigint, Oid bigint, kind string, status string, url string"


def random_log(rng, n, order_ids, hot=None):
    log = []
    for seq in range(1, n + 1):
        oid = hot if hot and rng.random() < 0.4 else rng.choice(order_ids)
        kind = rng.choice(["set", "set", "slip", "pay", "cancel", "confirm", "confirm"])
        value = rng.choice(["shipped", "Shipped", "delivered", "pending", None]) if kind == "set" else None
        url = rng.choice([f"u{seq}", None]) if kind in ("slip", "pay") else None
        log.append((seq, oid, kind, value, url))
    rng.shuffle(log)
    return log


def fold(states, log):
    """The log applied one event after the other."""
    now = {oid: [s, None, p] for oid, (s, p) in states.items()}
    taken = {}
    for seq, oid, kind, value, url in sorted(log):
        if oid not in now:
            taken[seq] = False
            continue
        order = now[oid]
        taken[seq] = True
        if kind == "set":
            order[0] = value
        elif kind == "cancel":
            order[0] = "cancelled"
        elif kind == "pay":
            order[0], order[1] = "waiting", url
        elif kind == "slip":
            if order[2] == "cod":
                taken[seq] = False
            else:
                order[0], order[1] = "waiting", url
        elif (order[0] or "").lower() == "shipped":
            order[0] = "delivered"
        else:
            taken[seq] = False
    return {oid: (s, u) for oid, (s, u, _) in now.items()}, taken


@pytest.mark.parametrize("seed, parts, step", [(1, None, 1), (2, 5, 1), (3, 40, 10**9), (4, 300, 7)])
def test_log_equals_one_event_after_the_other(spark, seed, parts, step):
    """Order 1 takes 40 % of all events; many parts cut its log; numbers need not be dense."""
    rng = random.Random(seed)
    states = {
        oid: (rng.choice(["shipped", "pending", None]), rng.choice(["cod", "transfer", None]))
        for oid in range(1, 41)
    }
    log = [(seq * step, *rest) for seq, *rest in random_log(rng, 700, [*states, 98, 99, None], hot=1)]
    want_state, want_taken = fold(states, log)
    table = orders_frame(spark, *[states[i] for i in range(1, 41)])
    state, decisions = oc.fold_order_log(table, spark.createDataFrame(log, LOG), parts)
    assert {r["Oid"]: (r["Ostatus"], r["Oslip"]) for r in rows(state)} == want_state
    assert {r["seq"]: r["accepted"] for r in rows(decisions)} == want_taken
    assert decisions.columns == ["seq", "Oid", "kind", "status", "url", "accepted"]


def test_no_part_of_the_log_holds_a_hot_order(spark):
    log = spark.range(20_000).selectExpr(
        "id * 1000000007 AS seq", "IF(id % 10 < 9, 1, id) AS Oid", "'set' AS kind", "'x' AS status", "null AS url"
    )
    cut = cut_sorted(log, ["Oid"], ["seq"], parts=16)
    sizes = [r["count"] for r in cut.groupBy("_part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 20_000 / 16


def test_unfit_values_refuse_their_own_row(spark, edge):
    schema = CHANGE + ", Payprice string, Tid string, slip string"
    new = [
        (1, 2, "12.345", "7", "a"),
        (2, 2, "abc", "7", "b"),
        (3, 2, "1000000000000", "3e9", "c"),
        (4, 2, "1", "x", "d"),
        (5, 2, None, "x", "e"),
    ]
    payments, orders, rejects = oc.record_payments(edge, spark.createDataFrame(new, schema), F.lit("2025-02-03").cast("timestamp_ntz"))
    assert [r["Payprice"] for r in rows(payments) if r["Payid"] > 4] == [money("12.35")]
    assert reasons(rejects) == {2: "unfit: Payprice", 3: "unfit: Payprice", 4: "unfit: Tid", 5: "incomplete"}
    assert by(orders, "Oid")[2]["Oslip"] == "/slips/a"


def test_order_requests_with_unfit_values(spark, edge):
    schema = "seq bigint, Cid bigint, payment string, totalPrice string, items array<struct<Pid:bigint,quantity:string,price:string>>"
    big = 1_700_000_000_000_000  # microseconds
    requests = [
        (big + 1, 1, "cod", "10", [(1, "2", "1.5")] * 10_000),
        (big + 2, 1, "cod", "much", [(1, "2", "1")]),
        (big + 3, 1, "cod", "1", [(1, "3000000000", "1")]),
        (big + 4, 1, "cod", "1", [(1, "2", "1"), (2, "1", "dear")]),
        (big + 5, 1, None, "1.005", [(2, "1", "2")]),
    ]
    placed, items, rejects = oc.place_orders(edge, spark.createDataFrame(requests, schema), "2025-02-03")
    assert set(by(placed, "seq")) == {big + 1, big + 5}
    lines = rows(items)
    top = max(r["Oiid"] for r in rows(edge["order_items"]))
    assert sorted(r["Oiid"] for r in lines) == [*range(top + 1, top + 10_001), top + 10_004]
    assert reasons(rejects) == {big + 2: "unfit: totalPrice", big + 3: "bad item", big + 4: "bad item"}


def test_state_reads_the_orders_once(spark, tmp_path):
    orders_frame(spark, ("shipped", "cod")).write.parquet(f"{tmp_path}/orders")
    table = spark.read.parquet(f"{tmp_path}/orders")
    log = spark.createDataFrame([(1, 1, "confirm", None, None)], LOG)
    for state in (
        oc.attach_slips(table, log.select("seq", "Oid", "url"))[0],
        oc.confirm_orders(table, log.select("seq", "Oid"))[0],
        oc.resolve_orders(table, oc.summarise_log(log, ["Oid"])),
    ):
        plan = state._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1
