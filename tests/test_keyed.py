"""Plans under skew: a third of all rows on one key."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from marketloom.functions.keyed import gather, join_grouped, only_keys, without_keys
from marketloom.operators import catalogue, orders
from marketloom.session import checkpoint_root, durable, scratch_path

SMALL = {
    "spark.sql.shuffle.partitions": "32",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def shuffled(spark):
    """Session in which nothing is broadcast and partitions count as large early."""
    before = {k: spark.conf.get(k) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def skewed(spark, tmp_path):
    path = str(tmp_path / "rows")
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 2000)
    spark.range(0, 300_000, 1, 8).select(
        key.cast("long").alias("k"), "id", F.sha1(F.col("id").cast("string")).alias("pad")
    ).write.parquet(path)
    return spark.read.parquet(path)


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_hot_key_is_split_against_a_grouped_side(shuffled, skewed, how):
    grouped = shuffled.range(0, 1000).withColumnRenamed("id", "k").groupBy("k").agg(
        F.count("*").alias("n")
    )
    joined = join_grouped(skewed, grouped, "k", how)
    assert "skew=true" in final_plan(joined)
    want = skewed.join(grouped, "k", how)
    assert joined.count() == want.count()
    assert joined.agg(F.sum("id")).first() == want.agg(F.sum("id")).first()


def test_keyed_filters_split_hot_keys(shuffled, skewed):
    keys = shuffled.range(0, 100).select(F.col("id").alias("k"))
    kept = only_keys(skewed, keys.union(keys), "k")
    assert "skew=true" in final_plan(kept)
    assert kept.count() + without_keys(skewed, keys, "k").count() == 300_000


def test_small_grouped_side_is_broadcast(spark, skewed):
    grouped = spark.range(0, 10).withColumnRenamed("id", "k").groupBy("k").agg(F.count("*"))
    assert "BroadcastHashJoin" in final_plan(join_grouped(skewed, grouped, "k", "left"))


def test_integer_types_hash_alike(spark):
    left = spark.createDataFrame([(1,), (None,)], "k bigint")
    right = spark.createDataFrame([(1,)], "k int")
    assert rows(join_grouped(left, right, "k", "left_semi")) == [{"k": 1}]
    assert rows(join_grouped(left, right, "k", "left_anti")) == [{"k": None}]


def test_keys_that_could_hash_apart_are_refused(spark):
    text = spark.createDataFrame([("a",)], "k string").select(F.collate("k", "UNICODE_CI").alias("k"))
    with pytest.raises(TypeError):
        join_grouped(text, text, "k", "inner")
    with pytest.raises(TypeError):
        join_grouped(spark.createDataFrame([(1.0,)], "k double"), text, "k", "inner")


def test_hot_customer_in_orders_is_split(shuffled, skewed):
    t = {
        "orders": skewed.select(
            F.col("id").alias("Oid"), F.col("k").alias("Cid"), F.col("pad").alias("Ostatus"),
            F.lit(1).cast("decimal(10,2)").alias("Oprice"), F.current_date().alias("Odate"),
        ),
        "customers": shuffled.range(0, 2000, 1, 4).select(
            F.col("id").alias("Cid"), F.col("id").cast("string").alias("Cname")
        ),
    }
    joined = orders.orders_with_customer(t)
    assert "skew=true" in final_plan(joined)
    assert joined.count() == 300_000


def test_hot_product_in_favorites_is_split(shuffled, skewed):
    t = {
        "favorites": skewed.select("id", F.col("id").alias("customer_id"), F.col("k").alias("product_id")),
        "products": shuffled.range(0, 2000, 1, 4).select(
            F.col("id").alias("Pid"),
            *[F.lit("x").alias(c) for c in ("Pname", "Ppicture")],
            F.lit(1).alias("Pprice"),
        ),
    }
    assert "skew=true" in final_plan(catalogue.favorite_products(t))


def test_lists_are_shuffled_once_for_grouping_and_join(shuffled, skewed):
    lists = gather(skewed, "k", F.collect_list("id"), "ids")
    keys = shuffled.range(0, 2000).withColumnRenamed("id", "k")
    plan = keys.join(lists, "k", "left")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2


def test_hot_order_is_split_in_the_flat_form(shuffled, skewed):
    t = {
        "orders": shuffled.range(0, 2000, 1, 4).select(
            F.col("id").alias("Oid"), F.lit(1).alias("Cid"), F.current_date().alias("Odate"),
            F.lit(3).alias("Oprice"),
        ),
        "order_items": skewed.select(
            F.col("id").alias("Oiid"), F.col("k").alias("Oid"), (F.col("id") % 50).alias("Pid"),
            F.lit(1).alias("Oquantity"), F.lit(2).alias("Oprice"),
        ),
        "products": shuffled.range(0, 50).select(
            F.col("id").alias("Pid"), F.lit("name").alias("Pname"), F.lit("url").alias("Ppicture")
        ),
    }
    flat = orders.order_items_flat(t)
    assert "skew=true" in final_plan(flat)
    assert flat.count() == 300_000


def test_filters_and_columns_reach_the_scan(spark, skewed):
    plan = skewed.where("k = 7").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,7)" in plan and "pad" not in plan.split("ReadSchema")[1]


def test_scratch_lies_below_the_checkpoint_folder(spark):
    root = checkpoint_root(spark)
    one, two = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert one != two and one.startswith(root)
    assert durable(spark.range(3)).count() == 3
