"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Streams keep a row per order, pair or bucket without end: state belongs on disk.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


# Shuffled bytes that one task is given at first; adaptive execution merges what turns out smaller.
_PARTITION_BYTES = 256 << 20


def build_session(
    app: str = "marketloom",
    master: str | None = None,
    shuffle_bytes: int | None = None,
    **settings,
) -> SparkSession:
    """Session with adaptive execution and ANSI errors on.

    Adaptive execution merges small shuffle partitions but never cuts evenly large ones, so it has
    to start with enough of them: give the size of the largest shuffle as ``shuffle_bytes``.
    Streams keep ``spark.sql.shuffle.partitions``, which fixes the layout of their state. Memory is
    left to the cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_bytes:
        parts = min(max(200, -(-shuffle_bytes // _PARTITION_BYTES)), 500_000)
        settings.setdefault("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
    for name, value in {**_SETTINGS, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is made only in local mode: executors of a cluster could not read it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="marketloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is ever written twice to one path."""
    return f"{checkpoint_root(spark)}/marketloom/{name}-{uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """The rows as a table written once to the shared folder.

    It survives lost executors and ends the lineage. Unlike ``checkpoint()``, which runs the last
    stage a second time to write it, the rows are computed once, and readers get their columns only.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
