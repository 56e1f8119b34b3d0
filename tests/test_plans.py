"""Rules that every plan has to keep, and scans that read no more than they must."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marketloom.plans import queries as registered
from marketloom.operators import feedback, orders
from marketloom.plans.driver_views import shop
from marketloom.session import build_session

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")

LAZY = [n for n in sorted(registered.queries()) if not n.startswith(("s", "x", "m03", "m17"))]


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def columns_read(df) -> list[set[str]]:
    """Columns of every scan in the plan."""
    return [
        set(re.findall(r"(\w+):", schema))
        for schema in re.findall(r"ReadSchema: struct<(.*?)>(?:\n|$)", physical(df))
    ]


@pytest.mark.parametrize("name", LAZY)
def test_no_plan_multiplies_or_gathers_rows(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(entry.queries()[name](spark, str(DATA)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "Broadcast"):
        assert banned not in plan
    assert not re.search(r"Window \[.*\], \[\], ", plan)  # a window without partitions
    # one partition only ever holds what a partial aggregate has reduced to a row per task
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "partial_" in lines[i + 1]


def test_scans_read_the_columns_they_need(spark):
    t = shop(spark, str(DATA), "orders", "reviews")
    assert columns_read(orders.sales_stats(t, "2001-07-31")) == [
        {"o_totalprice", "o_orderdate", "o_orderpriority"}
    ]
    assert {"o_orderkey"} in columns_read(feedback.reviews_with_order(t))


def test_filters_reach_the_scan(spark):
    t = shop(spark, str(DATA), "orders", "reviews")
    some = t["reviews"].where("id > 100").select("id")
    assert "GreaterThan(event_id,100)" in physical(some)


def test_unsorted_results_save_a_shuffle(spark):
    t = shop(spark, str(DATA), "orders", "order_items", "products")
    plain = orders.customer_orders_nested(t)
    assert "rangepartitioning" not in physical(plain)
    assert "rangepartitioning" in physical(orders.customer_orders_nested(t, ordered=True))
    assert plain.count() == orders.customer_orders_nested(t).agg(F.count("*")).first()[0]


def test_few_keys_are_met_before_anything_else_is_shuffled(spark):
    """The first join above every large scan is the one with the keys asked for."""
    t = shop(spark, str(DATA), "orders", "order_items", "products", "customers", "payments", "transfer", "reviews")
    one = spark.range(5, 6).withColumnRenamed("id", "Oid")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (
            orders.order_detail(t, one),
            feedback.payment_of_order(t, one),
            feedback.review_of_order(t, one.withColumnRenamed("Oid", "order_id")),
        ):
            joins = re.findall(r"(?:SortMergeJoin|ShuffledHashJoin).*", physical(df))
            assert any("LeftSemi" in j for j in joins)
            assert "LeftSemi" in joins[-1] or "Inner" not in joins[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_partitions_follow_the_size_of_the_shuffle(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        build_session(shuffle_bytes=10 << 40)
        assert spark.conf.get(name) == str((10 << 40) // (256 << 20))
        build_session(shuffle_bytes=1)
        assert spark.conf.get(name) == "200"
    finally:
        spark.conf.unset(name)
