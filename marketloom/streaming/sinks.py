"""Sink for reduced streams: a changelog of parquet folders, one per micro-batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketloom.functions.keyed import only_keys
from marketloom.operators.order_changes import fold_order_log
from marketloom.streaming.store import KeyedStore


def write_changelog(reduced: DataFrame, path: str, available_now: bool = False) -> StreamingQuery:
    """Start a query that writes the keys changed by each micro-batch below ``path``.

    Only changed keys are written (update mode). A micro-batch that is run again after a failure
    replaces its own folder, so the log holds every batch once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")

    writer = (
        reduced.writeStream.outputMode("update")
        .option("checkpointLocation", f"{path}/checkpoint")
        .foreachBatch(write)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_changelog(spark: SparkSession, path: str, keys: list[str], schema) -> DataFrame:
    """Newest row per key of a changelog."""
    try:
        rows = spark.read.schema(schema).parquet(f"{path}/log")
    except AnalysisException:  # no batch was written yet
        return spark.createDataFrame([], schema)
    rest = [c for c in schema.names if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "batch").alias("row"))
        .select(*keys, "row.*")
    )


def fold_stream(
    log: DataFrame,
    orders: DataFrame,
    path: str,
    available_now: bool = False,
    buckets: int = 64,
    fan: int = 8,
) -> StreamingQuery:
    """Start a query that applies an order log batch by batch and decides every event.

    Each micro-batch is folded by the batch operator, from the orders as earlier batches left them:
    ``order_store`` holds these below ``path/orders``, events with ``accepted`` go to
    ``path/decisions``, the events as they came to ``path/events``. Rows of one batch are taken by
    ``seq``, batches as they arrive. The stream begins with ``orders`` as its first batch finds them;
    from then on a batch reads the buckets of the orders that it names and nothing else.
    """
    spark = orders.sparkSession
    store = order_store(orders, path, buckets, fan)

    def write(batch: DataFrame, batch_id: int) -> None:
        # A stream's own session has adaptive execution turned off, so the batch is stored and then
        # folded in the session of the orders, where hot keys can be split.
        stored = f"{path}/events/batch={batch_id}"
        batch.write.mode("overwrite").parquet(stored)
        events = spark.read.schema(batch.schema).parquet(stored)
        if batch_id == 0:
            store.start(orders)
        held = store.stored(batch_id, store.buckets_of(events))
        named = store.newest(only_keys(held, events, "Oid"))
        state, decisions = fold_order_log(named, events)
        decisions.write.mode("overwrite").parquet(f"{path}/decisions/batch={batch_id}")
        store.put(batch_id, state)

    writer = log.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def order_store(orders: DataFrame, path: str, buckets: int = 64, fan: int = 8) -> KeyedStore:
    """The orders of the stream that ``fold_stream`` runs at ``path``."""
    return KeyedStore(orders.sparkSession, f"{path}/orders", orders.schema, "Oid", buckets, fan)


def run_available(reduced: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Run a reduced stream over all that its source holds and return the newest row per key."""
    spark = reduced.sparkSession
    write_changelog(reduced, path, available_now=True).awaitTermination()
    return read_changelog(spark, path, keys, reduced.schema)
