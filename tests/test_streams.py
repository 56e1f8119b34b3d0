"""Streams over files that arrive in several batches give what the batch operators give."""

import random
import re

import pytest
from conftest import frame, money, rows
from pyspark.sql import functions as F
from test_order_changes import LOG, orders_frame, random_log
from test_plans import physical

from marketloom.functions.dates import start_of
from marketloom.operators import order_changes as oc
from marketloom.operators import shop_changes as sc
from marketloom.streaming import changes as streams
from marketloom.streaming.sinks import (
    fold_stream,
    order_store,
    read_changelog,
    run_available,
    write_changelog,
)
from marketloom.streaming.store import KeyedStore


def arriving(spark, df, folder, files, order="seq"):
    """The rows of ``df`` as a stream of ``files`` files, one per micro-batch."""
    ranked = df.orderBy(order).collect()
    step = -(-len(ranked) // files)
    for i in range(0, len(ranked), step):
        part = spark.createDataFrame(ranked[i : i + step], df.schema)
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def as_set(df):
    columns = sorted(df.columns)
    return sorted(str(r) for r in rows(df.select(*columns)))


@pytest.mark.parametrize("files", [1, 4])
def test_order_status(spark, tmp_path, files):
    rng = random.Random(files)
    table = orders_frame(spark, *[("shipped", rng.choice(["cod", None])) for _ in range(20)])
    log = spark.createDataFrame(random_log(rng, 200, range(1, 23), hot=1), LOG)
    stream = arriving(spark, log, str(tmp_path / "in"), files)
    reduced = run_available(
        streams.stream_order_status(stream), str(tmp_path / "out"), streams.KEYS["order_status"]
    )
    want, _ = oc.fold_order_log(table, log)
    assert as_set(streams.order_status(table, reduced)) == as_set(want)


def test_order_decisions(spark, tmp_path):
    """Four batches, the last one run twice: every event is decided as in one batch."""
    rng = random.Random(11)
    table = orders_frame(spark, *[("shipped", rng.choice(["cod", None])) for _ in range(20)])
    log = spark.createDataFrame(random_log(rng, 200, range(1, 23), hot=1), LOG)
    stream = arriving(spark, log, str(tmp_path / "in"), 4)
    out = str(tmp_path / "out")
    fold_stream(stream, table, out, available_now=True).awaitTermination()
    commits = tmp_path / "out" / "checkpoint" / "commits"
    for name in ("3", ".3.crc"):  # as if the query had failed before it noted the last batch
        (commits / name).unlink(missing_ok=True)
    fold_stream(stream, table, out, available_now=True).awaitTermination()
    want_state, want = oc.fold_order_log(table, log)
    got = spark.read.parquet(f"{out}/decisions")
    assert got.select("batch").distinct().count() == 4
    assert as_set(got.drop("batch")) == as_set(want)
    store = order_store(table, out)
    assert as_set(store.newest(store.stored(4))) == as_set(want_state)


def test_order_decisions_over_many_batches(spark, tmp_path):
    """Twenty batches, merged by twos with a new base after every fourth; the rows that a batch reads
    are bounded by its buckets, not by what came before."""
    rng = random.Random(3)
    table = orders_frame(spark, *[("shipped", rng.choice(["cod", None])) for _ in range(40)])
    log = spark.createDataFrame(random_log(rng, 200, range(1, 43), hot=1), LOG)
    stream = arriving(spark, log, str(tmp_path / "in"), 20)
    out = str(tmp_path / "out")
    fold_stream(stream, table, out, available_now=True, buckets=8, fan=2).awaitTermination()
    want_state, want = oc.fold_order_log(table, log)
    assert as_set(spark.read.parquet(f"{out}/decisions").drop("batch")) == as_set(want)
    store = order_store(table, out, buckets=8, fan=2)
    assert as_set(store.newest(store.stored(20))) == as_set(want_state)
    for batch in (3, 7, 11, 15, 19):  # the batches that find most folders: base, 2 batches, 1 batch
        events = spark.read.parquet(f"{out}/events/batch={batch}")
        buckets = store.buckets_of(events)
        held = [v for v, _ in store.folders(batch)]
        assert held == [batch - 4, batch - 2, batch - 1]
        counts = dict(store.stored(batch, buckets).groupBy("_version").count().collect())
        keys = table.where(store.bucket().isin(buckets)).count()
        assert counts[held[0]] == keys
        assert sum(counts.values()) <= 3 * keys
        plan = physical(store.stored(batch, buckets))
        assert len(re.findall(r"PartitionFilters: \[[^\]]*_bucket", plan)) == len(held)


def test_store_folders():
    """Folders before a batch cover all earlier batches once, in order, and are few."""
    store = KeyedStore(None, "p", None, "k", fan=3)
    assert store.folders(0) == [(-1, "p/base/before=0")]
    assert store.folders(14) == [
        (8, "p/base/before=9"),
        (11, "p/log/level=1/upto=11"),
        (12, "p/log/level=0/upto=12"),
        (13, "p/log/level=0/upto=13"),
    ]
    assert max(len(store.folders(b)) for b in range(100)) == 5
    assert all(store.folders(b)[-1][0] == b - 1 for b in range(100))


def test_store_of_unknown_and_missing_keys(spark, tmp_path):
    """Batches that name no known order, or none at all, leave the orders as they are."""
    table = orders_frame(spark, ("shipped", None), ("waiting", "cod"))
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([(1, 99, "cancel", None, None)], [(2, None, "cancel", None, None)]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(LOG).parquet(folder)
        fold_stream(stream, table, out, available_now=True).awaitTermination()
    decisions = rows(spark.read.parquet(f"{out}/decisions"))
    assert [r["accepted"] for r in decisions] == [False, False]
    store = order_store(table, out)
    assert as_set(store.newest(store.stored(2))) == as_set(table)


def test_favorites(spark, tmp_path, edge):
    rng = random.Random(5)
    log = spark.createDataFrame(
        [(i, rng.randrange(3), rng.randrange(4)) for i in range(1, 60)],
        "seq bigint, customer_id bigint, product_id bigint",
    )
    stream = arriving(spark, log, str(tmp_path / "in"), 3)
    counts = run_available(
        streams.stream_favorites(stream), str(tmp_path / "out"), streams.KEYS["favorites"]
    )
    want, _ = sc.toggle_favorites(edge["favorites"], log)
    assert as_set(streams.favorites_after(edge["favorites"], counts)) == as_set(want)


def test_sales(spark, tmp_path, edge):
    stream = arriving(spark, edge["orders"], str(tmp_path / "in"), 3, "Oid")
    got = rows(
        run_available(streams.stream_sales(stream), str(tmp_path / "out"), streams.KEYS["sales"])
    )
    sales = {(r["grain"], str(r["bucket"])): (r["orders"], r["sales"]) for r in got}
    assert sales["week", "2024-12-30"] == (4, money(80))
    assert sales["month", "2025-01-01"] == (4, money(110))
    assert sales["day", "2021-01-03"] == (1, money(30))
    batch = edge["orders"].groupBy(start_of("week", "Odate").alias("w")).agg(F.sum("Oprice").alias("s"))
    assert {str(r["w"]): r["s"] for r in rows(batch)} == {
        b: s for (g, b), (_, s) in sales.items() if g == "week"
    }


def test_first_review(spark, tmp_path, edge):
    rng = random.Random(9)
    new = spark.createDataFrame(
        [
            (i, rng.choice([None, *range(1, 9)]), rng.choice(["t", None]), rng.randrange(7))
            for i in range(1, 80)
        ],
        "seq bigint, order_id bigint, text string, stars int",
    )
    stream = arriving(spark, new, str(tmp_path / "in"), 4)
    first = run_available(
        streams.stream_first_review(stream), str(tmp_path / "out"), streams.KEYS["first_review"]
    )
    accepted = streams.accepted_reviews(edge["reviews"], first)
    state, _ = sc.add_order_reviews(edge["reviews"], new)
    added = state.where("id > 4").select("order_id", (F.col("id") - 4).alias("seq"), "text", "stars")
    assert as_set(accepted) == as_set(added)


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    """A second run takes up the state of the first and adds only what is new."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "seq bigint, customer_id bigint, product_id bigint"
    for part in ([(1, 1, 1), (2, 2, 2)], [(3, 1, 1)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        write_changelog(streams.stream_favorites(stream), out, available_now=True).awaitTermination()
    counts = streams.stream_favorites(stream)
    got = rows(read_changelog(spark, out, streams.KEYS["favorites"], counts.schema))
    assert {(r["customer_id"], r["toggles"]) for r in got} == {(1, 2), (2, 1)}


def test_stream_without_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    empty = frame(spark, "favorites", []).withColumnRenamed("id", "seq")
    empty.write.parquet(folder)
    stream = spark.readStream.schema(empty.schema).parquet(folder)
    counts = run_available(
        streams.stream_favorites(stream), str(tmp_path / "out"), streams.KEYS["favorites"]
    )
    assert counts.count() == 0
